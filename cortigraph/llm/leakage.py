"""Evaluation passages inside training text, verbatim or with other values filled in."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Container, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortigraph.llm.mojibake import repair
from cortigraph.session import cut_lineage

#: Consecutive words, and letters and digits for languages written without blanks, that make a passage.
WORDS, LETTERS = 12, 24
#: Words of a joined window, and how many of them must not be names.
SEED, FIRM = 8, 3
#: Words of a passage that is the same but for its values.
TEMPLATE_WORDS = 16
#: Bits of the filters that stand for sets of words and windows in the scan: their size doesn't grow with the items.
FILTER_BITS = 1 << 26
UNSPACED = ("zh", "ja")

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_BLOCK = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|h[1-6]|table)\b[^<>]*>", re.I)
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿͏؜᠎]")
_MARK = re.compile("[̀-ͯ]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑][^\S\r\n]*(?:\r\n|\n|\r)\s*(?=[^\W\d_])")
_WORD = re.compile(r"(?:[^\W_]|�)+")
_ASCII_CORE = re.compile(r"[0-9a-z](?:.*[0-9a-z])?")
_FOREIGN = re.compile(r"[^0-9a-z]+")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿]")
_NAME, _NUMBER, _UNIT = "\x01w", "\x01n", "\x01u"


def canonical(text: str) -> str:
    """Case, code-point forms, entities, mark-up, hidden characters and wrong decoding levelled."""
    s, _ = repair(text)
    if "&" in s:
        s = html.unescape(s)
    if "<" in s:
        s = _TAG.sub("", _BLOCK.sub(" ", s))
    if not s.isascii():
        s = _HIDDEN.sub("", s)
        s = unicodedata.normalize("NFKC", s)
    s = s.casefold()
    return s if s.isascii() else _MARK.sub("", unicodedata.normalize("NFC", s))


def words_of(s: str) -> list[str]:
    return _WORD.findall(s)


def letters_of(s: str) -> str:
    return "".join(words_of(s))


def lossy(word: str) -> str:
    """What is left of a Latin word when its other letters are lost; '' if nothing is."""
    if word.isascii():
        return word
    m = _ASCII_CORE.search(word)
    if m:
        return _FOREIGN.sub("*", m.group())
    return "" if len(word) == 1 and ord(word) < 0x250 or not word.strip("�") else word


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "replace"))


_MUL = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(64)]


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out += values[j : j + n] * _MUL[j]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Filter:
    """A set of 64-bit hashes as two bits each of FILTER_BITS: nothing in it is missed, few others are taken for members."""

    def __init__(self, slots: np.ndarray, bits: np.ndarray):
        dense = np.zeros(FILTER_BITS >> 6, np.uint64)
        dense[slots] = bits
        self.dense, self.raw = dense, memoryview(dense).cast("B")

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for shift in (0, 32):
            at = (hashes >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)
            out &= (self.dense[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def __contains__(self, word: str) -> bool:
        h = _hash(word)
        a, b = h & (FILTER_BITS - 1), h >> 32 & (FILTER_BITS - 1)
        return bool(self.raw[a >> 3] >> (a & 7) & 1 and self.raw[b >> 3] >> (b & 7) & 1)


def filter_of(hashes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Filter's content for a table of hashes (hash bigint): at most FILTER_BITS / 64 numbers, whatever the table."""
    at = F.explode(F.array(*[F.shiftrightunsigned("hash", n).bitwiseAND(F.lit(FILTER_BITS - 1)) for n in (0, 32)]))
    bits = hashes.select(at.alias("at")).select((F.col("at") / 64).cast("int").alias("slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int")).alias("bit"))
    t = bits.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    return t.column("slot").to_numpy(), t.column("bits").to_numpy().astype(np.uint64)


class Slots:
    """Typed placeholders: numbers, units, and every word that is no part of the items' wording."""

    def __init__(self, wording: Container[str], units: Container[str] = frozenset()):
        self.wording, self.units = wording, units
        self.keys: dict[str, tuple[str, str, int, int]] = {}

    def of(self, word: str) -> tuple[str, str, int, int]:
        """Lossy form, placeholder or word, and the hashes of both."""
        got = self.keys.get(word)
        if got is None:
            key = lossy(word)
            slot = _NUMBER if word.isdigit() else _UNIT if key in self.units else key if key in self.wording else _NAME
            got = (key, slot, _hash(key), _hash(slot))
            if len(self.keys) > 300_000:
                self.keys.clear()
            self.keys[word] = got
        return got


_DIGITS = re.compile(r"\d+")
_KATAKANA = re.compile("[ァ-ヺー]+")
_PIECE = re.compile(r"\d+|[ァ-ヺー]+|.", re.S)


def pieces_of(letters: str) -> tuple[list[str], list[str]]:
    """Letters with every number and katakana word as one piece, and the same with those as placeholders."""
    pieces = _PIECE.findall(letters)
    return pieces, [_NUMBER if p[0].isdigit() else _NAME if _KATAKANA.match(p) else p for p in pieces]


def _letter_values(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers, literally and with numbers and katakana words as one placeholder each."""
    masked = _KATAKANA.sub("ア", _DIGITS.sub("0", letters))
    mix = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    return mix(letters), mix(masked)


def seeds_of(s: str, slots: Slots, widths: list[int], letter_widths: list[int]) -> np.ndarray:
    """Hashes of the template windows and the literal windows of a canonical text."""
    out = []
    if widths:
        keys = [k for k in map(slots.of, words_of(s)) if k[0]]
        literal = np.array([k[2] for k in keys], np.uint64)
        template = np.array([k[3] for k in keys], np.uint64)
        for w in widths:
            out += [rolled(literal, w), rolled(template, w)]
    if letter_widths and _UNSPACED.search(s):
        literal, template = _letter_values(letters_of(s))
        for w in letter_widths:
            out += [rolled(literal, w), rolled(template, w)]
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Item:
    """An item's passages: the strings that prove it and the window hashes that find it."""

    def __init__(self, item_id: int, lang: str | None, text: str, slots: Slots):
        self.id = item_id
        s = canonical(text)
        self.unspaced = (lang or "").lower()[:2] in UNSPACED
        self.words = words_of(s)
        self.letters = letters_of(s)
        self.seeds: dict[int, int] = {}
        if self.unspaced:
            n = min(LETTERS, len(self.letters))
            self.width = n
            self.passages = {self.letters[i : i + n] for i in range(len(self.letters) - n + 1)} if n else set()
            self.lossy_passages = self.passages
            if n:
                literal, template = _letter_values(self.letters)
                self.words, self.template = pieces_of(self.letters)
                self._spans(LETTERS)
                self.seeds |= dict.fromkeys(rolled(literal, n).tolist(), n) | dict.fromkeys(rolled(template, self.span).tolist(), self.span)
            return
        n = min(WORDS, len(self.words))
        runs = [self.words[i : i + n] for i in range(len(self.words) - n + 1)] if n else []
        self.passages = {f" {' '.join(r)} " for r in runs}
        self.lossy_passages = set()
        self.width = 0
        for r in runs:
            keys = [k for k in map(slots.of, r) if k[0]]
            self.lossy_passages.add(f" {' '.join(k[0] for k in keys)} ")
            w = min(SEED, len(keys))
            if not w:
                continue
            self.width = w
            template = np.array([k[3] for k in keys], np.uint64)
            firm = [sum(k[1] != _NAME for k in keys[i : i + w]) for i in range(len(keys) - w + 1)]
            good = {int(h) for h, f in zip(rolled(template, w), firm) if f >= FIRM}
            # Every run has a window that finds it: by its wording, else by its words.
            self.seeds |= dict.fromkeys(good or {int(rolled(np.array([k[2] for k in keys], np.uint64), w)[0])}, w)
        self.template = [slots.of(w)[1] for w in self.words]
        self._spans(TEMPLATE_WORDS)

    def windows(self) -> Iterator[tuple[int, int]]:
        """(hash, width) of the windows that find the item."""
        yield from self.seeds.items()

    def _spans(self, most: int) -> None:
        """Where each window of the template begins."""
        n = self.span = min(most, len(self.template))
        self.starts: dict[tuple, list[int]] = {}
        for i in range(len(self.template) - n + 1):
            self.starts.setdefault(tuple(self.template[i : i + n]), []).append(i)


def filled_in(item: Item, words: list[str], template: list[str], windows: dict[int, dict[tuple, list[int]]]) -> tuple[int, int]:
    """(words, changed slots) of the longest run of the item's wording with other values.

    The values must be consistent: a value of the item stands for one value of the
    document throughout, and back. (0, 0) if there is no run of the item's span.
    `windows` keeps the document's windows by length for the next item.
    """
    n = item.span
    if n < SEED:
        return 0, 0
    if n not in windows:
        windows[n] = {}
        for j in range(len(template) - n + 1):
            windows[n].setdefault(tuple(template[j : j + n]), []).append(j)
    best = (0, 0)
    for shared in item.starts.keys() & windows[n].keys():
        for i, j in ((i, j) for i in item.starts[shared] for j in windows[n][shared]):
            if i and j and item.template[i - 1] == template[j - 1]:
                continue  # inside a run of the template, which is walked from its start
            best = max(best, consistent_run(item.words, words, item.template, template, i, j, n))
    return best


def consistent_run(ours: Sequence[str], theirs: Sequence[str], template: Sequence[str], other: Sequence[str], i: int, j: int, least: int) -> tuple[int, int]:
    """(length, changed slots) of the longest consistent run of `least` or more on the diagonal from (i, j), as long as the templates agree.

    At a conflict the run goes on behind the earlier occurrence of the conflicting value.
    """
    best, first, changed, k = (0, 0), 0, [0], 0
    there: dict[str, tuple[str, int]] = {}
    back: dict[str, tuple[str, int]] = {}
    while i + k < len(template) and j + k < len(other) and template[i + k] == other[j + k]:
        a, b = ours[i + k], theirs[j + k]
        slot = template[i + k] in (_NAME, _NUMBER)
        if slot:
            for x, y, map_ in ((a, b, there), (b, a, back)):
                was = map_.get(x)
                if was and was[0] != y and was[1] >= first:
                    first = was[1] + 1
            there[a], back[b] = (b, k), (a, k)
        changed.append(changed[-1] + (slot and a != b))
        k += 1
        if k - first >= least and changed[k] > changed[first]:
            best = max(best, (k - first, changed[k] - changed[first]))
    return best


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def word_counts(items: DataFrame, text: str) -> DataFrame:
    """hash, n_items, n, n_counted of the items' words: items and places they stand in, places behind a number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for v in b.column(0):
                seen: dict[str, list[int]] = {}
                before = ""
                for w in words_of(canonical(v.as_py())):
                    if (key := lossy(w)) and not w.isdigit():
                        n = seen.setdefault(key, [0, 0])
                        n[0] += 1
                        n[1] += before.isdigit()
                    before = w
                out[0].extend(map(_hash, seen))
                for i in (0, 1):
                    out[i + 1].extend(n[i] for n in seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.array(out[0], np.uint64))), *[pa.array(x, pa.int64()) for x in out[1:]]], names=["hash", "n", "n_counted"])

    one = items.select(text).mapInArrow(count, "hash bigint, n bigint, n_counted bigint")
    return one.groupBy("hash").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("n"), F.sum("n_counted").alias("n_counted"))


def covered(item: Item, text: str, words: list[str]) -> set[int]:
    """Places of the words (one blank before and after each in `text`) that hold the item's passages."""
    out: set[int] = set()
    starts = None
    for p in item.passages:
        at = text.find(p)
        while at >= 0:
            if starts is None:
                starts = [0, *accumulate(len(w) + 1 for w in words)]
            first = bisect_right(starts, at) - 1
            out.update(range(first, first + p.count(" ") - 1))
            at = text.find(p, at + 1)
    return out


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, item_lang: str) -> DataFrame:
    """(doc id, item_id, kind, n_words, n_changed): documents that hold items.

    kind 'verbatim': at least WORDS consecutive words of the item (all of them if
    it has fewer), or LETTERS consecutive letters and digits for items in
    languages written without blanks; n_words is then the item's length. kind
    'template': no such passage, but at least TEMPLATE_WORDS words of the item's
    wording in which names and numbers were replaced, each consistently; in languages
    without blanks at least LETTERS letters in which numbers and katakana words were
    (each counts as one letter; names in Han letters can't be told from wording).
    A passage that is another item verbatim is no template of this one.

    Documents and items are canonicalised alike (see `canonical`); numbers, units
    and words that aren't part of the items' wording become typed placeholders,
    and windows of SEED words are joined by hash. Wording are the words of two
    items or more, units those of them that stand behind a number in half of their
    places or more; both are counted over all items. The passages of the joined pairs
    are then compared, so a shared hash or template alone reports nothing. Lost
    letters (U+FFFD) match any letter. Null, empty and repeated items and texts:
    null and empty match nothing, repeated documents give repeated rows, null
    document ids stay null; item ids are unique, items without id are left out, a null
    language is one with blanks. Other columns of both tables are ignored.

    Words, windows and texts of the items are tables. What the scan of the
    documents is given of them are filters of a fixed size, so neither the driver
    nor a broadcast holds more when there are more items, and one pass over the
    documents does for any number; what a filter lets through in vain dies in the
    join. Documents without a shared window are dropped in the scan; there is no
    shuffle of texts but of those with one.
    """
    spark = docs.sparkSession
    rows = items.where(F.col(item_id).isNotNull() & (F.length(item_text) > 0)).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_lang).alias("lang"), F.col(item_text).alias("text"))
    id_type = docs.schema[doc_id].dataType.simpleString()
    words = cut_lineage(word_counts(rows, "text").where("n_items > 1"))
    wording = spark.sparkContext.broadcast((filter_of(words), filter_of(words.where("2 * n_counted >= n"))))

    def slots_of() -> Slots:
        return Slots(Filter(*wording.value[0]), Filter(*wording.value[1]))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = slots_of()
        for b in batches:
            found = []
            for i, lang, t in zip(*(c.to_pylist() for c in b.columns)):
                x = Item(i, lang, t, slots)
                found += [(h, i, w, x.unspaced) for h, w in x.windows()]
            h, i, w, u = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.array(h, np.uint64))), pa.array(i, pa.int64()), pa.array(w, pa.int32()), pa.array(u, pa.bool_())], names=["hash", "item_id", "width", "unspaced"])

    sought = cut_lineage(rows.mapInArrow(windows, "hash bigint, item_id bigint, width int, unspaced boolean"))
    kinds = [(r["unspaced"], r["width"]) for r in sought.select("unspaced", "width").distinct().collect()]  # widths are at most SEED and LETTERS
    shared = spark.sparkContext.broadcast((sorted(w for u, w in kinds if not u), sorted(w for u, w in kinds if u), filter_of(sought)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, letter_widths, content = shared.value
        slots, known = slots_of(), Filter(*content)
        for b in batches:
            rows, hits, texts = [], [], []
            for i, v in enumerate(b.column(1)):
                t = v.as_py()
                if not t:
                    continue
                forms = [canonical(t)]
                if _HYPHEN.search(t):
                    forms.append(canonical(_HYPHEN.sub("", t)))
                found = np.concatenate([seeds_of(s, slots, widths, letter_widths) for s in forms])
                hit = np.unique(found[known.holds(found)])
                if len(hit):
                    rows.append(i)
                    hits.append(_signed(hit))
                    texts.append("\x00".join(forms))
            ids = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hits, pa.list_(pa.int64())), pa.array(texts, pa.string())], names=["id", "hits", "forms"])

    # Only documents that share a window with an item go on; they are written once and read twice.
    held = cut_lineage(docs.select(doc_id, text).mapInArrow(find, f"id {id_type}, hits array<bigint>, forms string").withColumn("row", F.monotonically_increasing_id()))
    pairs = held.select("row", F.explode("hits").alias("hash")).join(sought.select("hash", "item_id").distinct(), "hash").select("row", "item_id").distinct()
    pairs = pairs.join(rows, "item_id").groupBy("row").agg(F.collect_list(F.struct("item_id", "lang", "text")).alias("items"))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, made = slots_of(), {}
        for b in batches:
            rows, out = [], ([], [], [], [])
            for i, (forms, items) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if len(made) > 20_000:
                    made.clear()
                known = [made.get(r["item_id"]) or made.setdefault(r["item_id"], Item(r["item_id"], r["lang"], r["text"], slots)) for r in items]
                for item_id, verbatim, run, changed in held_items(forms.split("\x00"), sorted(known, key=lambda x: x.id), slots):
                    rows.append(i)
                    for o, v in zip(out, (item_id, "verbatim" if verbatim else "template", run, changed)):
                        o.append(v)
            cols = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *cols], names=["id", "item_id", "kind", "n_words", "n_changed"])

    both = held.join(pairs, "row").select("id", "forms", "items")
    return both.mapInArrow(prove, f"id {id_type}, item_id bigint, kind string, n_words int, n_changed int").withColumnRenamed("id", doc_id)


def held_items(forms: list[str], items: list[Item], slots: Slots) -> Iterator[tuple[int, bool, int, int]]:
    """(item id, verbatim, words, changed slots) of the items that a document's canonical forms hold."""
    words = [words_of(s) for s in forms]
    plain = [f" {' '.join(w)} " for w in words]
    left = [f" {' '.join(k for k in (slots.of(x)[0] for x in w) if k)} " if "�" in s else "" for w, s in zip(words, forms)]
    letters = ["".join(w) for w in words]
    taken: set[int] = set()
    rest, others = letters[-1], []
    for x in items:
        where = letters if x.unspaced else plain
        if any(p in s for s in where for p in x.passages) or not x.unspaced and any(p in s for s in left if s for p in x.lossy_passages):
            yield x.id, True, len(x.letters) if x.unspaced else len(x.words), 0
            if x.unspaced:
                for p in x.passages:
                    rest = rest.replace(p, "\x02" * len(p))
            else:
                taken |= covered(x, plain[-1], words[-1])
        else:
            others.append(x)
    if not others:
        return
    # What is an item verbatim can't be a template of another.
    template, windows = ["\x02" if i in taken else slots.of(w)[1] for i, w in enumerate(words[-1])], {}
    unspaced = (*pieces_of(rest), {})
    for x in others:
        run, changed = filled_in(x, *unspaced) if x.unspaced else filled_in(x, words[-1], template, windows)
        if run:
            yield x.id, False, run, changed
