"""Sentence units across languages and scripts."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortigraph.llm.mojibake import repair

# Abbreviations assumed where a corpus says nothing of them.
BEFORE_NAME = "Dr Dra Mr Mrs Ms Prof St Sr Sra Srta Jr Mme Mlle Hr Fr Rev Gen Col Capt Lt Sgt Av av ul ул пр им г гг рис Рис Mag Ing Lic Dott Sig"
BEFORE_NUMBER = "No no Nr nr núm Núm num nº fig Fig Abb abb p pp pág cap Cap vol Vol art Art sec Sec ch Ch табл рис стр ст д кв approx aprox ca env ok c n S s tel Tel"
INSIDE = "cf vs e.g i.e al viz bzw vgl Vgl ggf evtl inkl z u d h m.in tzn tj np por ej ex См см тыс млн руб ул env approx aprox ca Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"
MAY_END = "etc usw Ltd Inc Co Corp a.m p.m U.S итд др пр itd itp bzgl"
# Month names that follow an ordinal written with a dot.
MONTHS = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|stycznia|januar|februar|marts?|april|maj|mai|juni|juli|august|september|oktober|november|desember|december)\b|M.rz\b|J.nner\b")

NAME, NUMBER, NEVER, END = "name", "number", "never", "end"
SEEDS = {w: k for k, ws in ((END, MAY_END), (NUMBER, BEFORE_NUMBER), (NEVER, INSIDE), (NAME, BEFORE_NAME)) for w in ws.split()}

_BREAK = re.compile(r"(?>\r\n|\n|\r| |\x85)[^\S\r\n \x85]*(?>\r\n|\n|\r| |\x85)\s*| \s*")
_QUOTES = "\"“”„‟«»「」『』〝〞‹›"
_EVENT = re.compile(f"[{_QUOTES}]|[.!?…。！？｡．।॥؟۔։]+|(?<=[ก-ฺเ-๎])[^\\S\r\n \x85]+(?=[ก-ฺเ-๎])")
_OPEN = {"“": "”", "«": "»", "「": "」", "『": "』", "‹": "›", "„": "“”\"", "〝": "〞", "‟": "”", '"': '"'}
_HARD = frozenset("。！？｡．।॥؟۔։")
_AFTER = frozenset(")]}’')】）")
_WORD = re.compile(r"[^\W_]+(?:[.\-'’][^\W_]+)*")
_MARKS = "\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff"
_IN_TOKEN = frozenset(".-�ºª\u00ad\u200b\u200c\u200d\u2060\ufeff") | frozenset(map(chr, range(0x300, 0x370)))
_COMPOSE = re.compile(f"[{_MARKS}]")
_JOINED = frozenset("とっはをがのにもでへやか")
_INVISIBLE = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff"))
_LEAD = re.compile(r"\s*")


def _caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def _closed_by(marks: list[tuple[int, str]], q: str, closers: str) -> dict[int, int]:
    """Mark that closes each mark `q`, where marks `q` nest and `closers` end them."""
    if q in closers:
        level = None
    else:
        level, depth = [], 0
        for _, p in marks:
            depth += (p == q) - (p in closers)
            level.append(depth)
    out, last = {}, {}
    for i in range(len(marks) - 1, -1, -1):
        p = marks[i][1]
        if p == q and (level[i] - 1 if level else 0) in last:
            out[i] = last[level[i] - 1 if level else 0]
        if p in closers:
            last[level[i] if level else 0] = i
    return out


def quote_spans(s: str) -> list[tuple[int, int]]:
    """(open, close) of paired quotation marks, outermost only; unpaired marks are text."""
    marks = [(m.start(), m.group()) for m in re.finditer(f"[{_QUOTES}]", s)]
    spans, i, n = [], 0, len(marks)
    pairs: dict[tuple[str, str], dict[int, int]] = {}
    while i < n:
        at, q = marks[i]
        closers = _OPEN.get(q)
        if q == "»" and at + 1 < len(s) and not s[at + 1].isspace():
            closers = "«"
        elif q == '"' and at and (s[at - 1].isalnum() or s[at - 1] in ".!?,"):
            closers = None
        elif q == "“" and at and s[at - 1].isalnum():
            closers = None
        if closers:
            if (q, closers) not in pairs:
                pairs[q, closers] = _closed_by(marks, q, closers)
            j = pairs[q, closers].get(i)
            if j is not None:
                spans.append((at, marks[j][0]))
                i = j
        i += 1
    return spans


def paragraphs(s: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _BREAK.finditer(s):
        yield at, m.start()
        at = m.end()
    yield at, len(s)


# A token is taken from where its run of letters, digits, dots and hyphens begins.
_DOTTED = re.compile(rf"(?<![^\W_])(?<![.\-�ºª{_MARKS}])((?:[^\W_]|[.\-�ºª{_MARKS}])+)(?<!\.)\.(?!\.)(?=(\s*)(\S?))")
_UNIT = re.compile(r"[!?…]|\n[^\S\n]*\r?\n")
_UPPER = regex.compile(r"[\p{Uppercase}\p{Lt}]")
_PARTS = re.compile(r"[^\W_]+")
#: A longer run of letters, dots and hyphens is no abbreviation (hosts, chains of initials): its last part is looked at.
LONGEST = 64


class Document:
    """What one document says of its own abbreviations and names, looked up when needed."""

    def __init__(self, text: str, corpus: dict[str, str]):
        self.text, self.corpus = text, corpus
        self._seen: dict[str, tuple[str | None, str]] = {}
        self._dots: dict[str, tuple[bool, bool]] | None = None
        self._danda: bool | None = None
        self._upper: list[int] | None = None
        self._words: tuple[set[str], set[str]] | None = None
        self.sources: Counter = Counter()

    def kind(self, token: str) -> str | None:
        """What the dot after this token is: a kind of abbreviation, or None for an end mark."""
        found = self._seen.get(token)
        if found is None:
            found = self._seen[token] = self._kind(token)
        self.sources[found[1]] += 1
        return found[0]

    def token_before(self, start: int, a: int) -> str:
        """The token that ends at `a`, not before `start`."""
        s, i, first = self.text, a, max(start, a - LONGEST)
        while i > first and (s[i - 1].isalnum() or s[i - 1] in _IN_TOKEN):
            i -= 1
        return s[i:a]

    def upper(self) -> list[int]:
        """Places of the capitals."""
        if self._upper is None:
            self._upper = [m.start() for m in _UPPER.finditer(self.text)]
        return self._upper

    def flat(self, a: int, b: int) -> bool:
        """Letters with case between a and b, and no capital among them."""
        up = self.upper()
        k = bisect_left(up, a)
        return not (k < len(up) and up[k] < b) and any(self.text[i].islower() for i in range(a, min(b, len(self.text))))

    def _kind(self, token: str) -> tuple[str | None, str]:
        """Kind and what decided it: the document, the corpus, the list, or nothing."""
        if token.isdigit():
            return None, "none"
        # The document says whether it is an abbreviation; what may follow one is for the corpus and the list to say.
        own, known = self._own(token), SEEDS.get(token)
        kind = self.corpus.get(token, known)
        if own:
            return kind or known or NEVER, "document"
        if own is False:
            return END if kind == END else None, "document"
        if kind is not None:
            return kind or None, "corpus" if token in self.corpus else "list"
        return NUMBER if "�" in token and len(token) <= 4 else None, "none"

    def _own(self, token: str) -> bool | None:
        """Is this an abbreviation by its unambiguous occurrences here? None if there are none, or of both kinds.

        For it: the dot before a comma, or before a small letter in text with capitals.
        Against it: the dot at the end of a block of lines, or no dot after a lower-case word.
        """
        if self._dots is None:
            self._dots = self._occurrences()
        within, against = self._dots.get(token, (False, False))
        return None if within == against else within

    def _occurrences(self) -> dict[str, tuple[bool, bool]]:
        """(for, against) of every token with a dot, in one pass over the text."""
        text, within, against = self.text, set(), set()
        unit, seen = 0, set()
        ends: list[int] | None = None
        for m in _DOTTED.finditer(text):
            token, gap, nxt = m.groups()
            if len(token) > LONGEST:
                continue
            if _COMPOSE.search(token):
                token = unicodedata.normalize("NFC", token).translate(_INVISIBLE)
            tokens = {token, token.rpartition("-")[2]}
            seen |= tokens
            if not nxt or gap.count("\n") > 1:
                against |= tokens
            elif nxt in ",;:":
                within |= tokens
            elif gap and nxt.islower():
                if ends is None:
                    ends = [u.end() for u in _UNIT.finditer(text)]
                k = bisect_right(ends, m.end())
                if not (self.flat(max(unit, ends[k - 1] if k else 0), m.end()) and text[m.start(3) : m.start(3) + 40].islower()):
                    within |= tokens
            unit = m.end()
        words = text.split()
        plain = seen.intersection(words)
        if plain:
            against |= {w for before, w in zip(words, words[1:]) if w in plain and before.rstrip(",")[-1:].islower()}
        return {t: (t in within, t in against) for t in within | against}

    def proper(self, word: str) -> bool:
        """Is this capitalised word seen with its capital after a lower-case word, and never in lower case?"""
        if self._words is None:
            named, words = set(), set()
            for m in _WORD.finditer(self.text):
                whole = m.group()
                for at, w in {(m.start(), whole), *((p.start(), p.group()) for p in _PARTS.finditer(self.text, m.start(), m.end()))}:
                    words.add(w)
                    if w[0].isupper() and w not in named:
                        i = at
                        while i and self.text[i - 1] in " ,":
                            i -= 1
                        if i and self.text[i - 1].islower():
                            named.add(w)
            self._words = named, words
        named, words = self._words
        return word in named and word.lower() not in words

    def danda(self) -> bool:
        if self._danda is None:
            self._danda = "।" in self.text
        return self._danda


def _dot(s: str, a: int, start: int, after: int, nxt: str, gap: bool, doc: Document) -> bool:
    """Does the single dot at `a` end a sentence? `after`: place of the next character `nxt`."""
    token = doc.token_before(start, a)
    if not gap and not (nxt.isupper() or nxt in "¿¡" or nxt in _OPEN or (_caseless(nxt) and token[-1:].isalpha())):
        return False
    if _COMPOSE.search(token):
        token = unicodedata.normalize("NFC", token).translate(_INVISIBLE)
    if "ऀ" <= s[a - 1] <= "ॿ" and doc.danda():
        return False
    if not token:
        return True
    last = token[-1]
    if last.isdigit():
        return not MONTHS.match(s, after)
    if "." in token and not gap and not token.rpartition(".")[2].isalpha():
        return False
    core = token.rpartition("-")[2]
    kind = doc.kind(token) or (doc.kind(core) if core != token else None)
    if kind is None and len(core.rpartition(".")[2]) == 1 and core[-1].isalpha() and not ("一" <= last <= "鿿" or "぀" <= last <= "ヿ"):
        kind = END if "." in core and core.replace(".", "").islower() else NAME
    if kind is None:
        return True
    if kind == NUMBER:
        return not (nxt.isdigit() or nxt in "$€£¥" or nxt == "�")
    if kind == END:
        if nxt.isupper():
            w = _WORD.match(s, after)
            return not (w and doc.proper(w.group()))
        return nxt in _OPEN or nxt in "¿¡"
    return False


def boundaries(s: str, start: int, end: int, doc: Document) -> list[int]:
    """Ends of units inside the paragraph s[start:end]."""
    para = s[start:end]
    spans = [(a + start, b + start) for a, b in quote_spans(para)] if any(q in para for q in _QUOTES) else []
    k, unit, cuts = 0, start, []
    for m in _EVENT.finditer(s, start, end):
        a, b = m.span()
        c = s[a]
        while k < len(spans) and spans[k][1] < a:
            k += 1
        inside = k < len(spans) and spans[k][0] < a < spans[k][1]
        if inside:
            continue
        if c in _QUOTES:
            if not (k < len(spans) and spans[k][1] == a):
                continue
            # A quotation closes: it ends a unit if it ended a sentence and nobody is named as its speaker.
            inner = s[spans[k][0] + 1 : a].rstrip()
            if not inner or inner[-1] not in ".!?…。！？।॥؟۔" or inner[-1] == "." and inner[-3:-2] == ".":
                continue
            e = a + 1
            while e < end and s[e] in _AFTER:
                e += 1
            after = _LEAD.match(s, e, end).end()
            if after >= end:
                continue
            nxt = s[after]
            if nxt.islower() or nxt in ",;:—–-.!?…。！？।، 、，" or nxt in _AFTER:
                continue
            if _caseless(nxt):
                alone = not s[unit : spans[k][0]].strip()
                if alone or ("぀" <= nxt <= "ヿ" and nxt in _JOINED):
                    continue
            cuts.append(e)
            unit = e
            continue
        if c.isspace():
            cuts.append(a)
            unit = b
            continue
        e = b
        while e < end and s[e] in _AFTER:
            e += 1
        if e < end and s[e] in _QUOTES and k < len(spans) and spans[k][1] == e:
            continue
        after = _LEAD.match(s, e, end).end()
        if after >= end:
            continue
        nxt, gap = s[after], after > e
        if s[b - 1] in _HARD:
            if nxt in "、，,":
                continue
        elif nxt in ",;:，、،%" or nxt.islower() and not (gap and a - unit > 20 and s[after : after + 40].islower() and doc.flat(unit, a)):
            continue
        elif "…" in m.group() or (b - a > 1 and m.group().strip(".") == ""):
            if not (nxt.isupper() or nxt in _OPEN or nxt in "¿¡"):
                continue
        elif c == "." and b - a == 1:
            if not _dot(s, a, start, after, nxt, gap, doc):
                continue
        elif not gap and not (nxt.isupper() or nxt in _OPEN or nxt in "¿¡©" or _caseless(nxt)):
            continue
        cuts.append(e)
        unit = e
    return cuts


def units(text: str, corpus: dict[str, str], sources: Counter | None = None) -> list[tuple[int, int]]:
    """(start, end) of every unit of a text, in code points, without blanks around it; `sources` counts what judged the dots."""
    s, places = repair(text)
    doc = Document(s, corpus)
    if sources is not None:
        doc.sources = sources
    out = []
    for a, b in paragraphs(s):
        at = a
        for cut in [*boundaries(s, a, b, doc), b]:
            piece = s[at:cut]
            body = piece.strip()
            if body:
                x = at + len(piece) - len(piece.lstrip())
                out.append((x, x + len(body)))
            at = cut
    return out if places is None else [(places[x], places[y - 1] + (places[y] - places[y - 1])) for x, y in out]


# Letters after a digit and a hyphen are a token; inside a run of letters, dots and hyphens none begins.
_WORDS = re.compile(r"(?<![^\W_])(?<![^\W\d_][.\-])(?<![.\-][.\-])((?:[^\W\d_]|[.\-])+)(?<!\.)\.(?!\.)(?=(\s*)(\S{0,3}))")


def dot_evidence(text: str, counts: Counter) -> None:
    """Count what follows tokens with a dot: block end, lower case or comma, digit, capital."""
    s, _ = repair(text)
    for a, b in paragraphs(s):
        if "." not in s[a:b]:
            continue
        p = s[a:b]
        spans = quote_spans(p) if any(q in p for q in _QUOTES) else []
        k = 0
        for m in _WORDS.finditer(p):
            at = m.end()
            while k < len(spans) and spans[k][1] <= at:
                k += 1
            if k < len(spans) and spans[k][0] < at or m.end(1) - m.start(1) > LONGEST:
                continue
            word = m.group(3)
            c = word[:1]
            if not c:
                kind = "e"
            elif not m.group(2) and c not in ",;:)":
                continue
            else:
                kind = "l" if c.islower() or c in ",;:" else "n" if c.isdigit() or c in "$€" else "c" if c.isalpha() else "o"
            counts[m.group(1), kind, word[:3] if kind == "c" else ""] += 1


def _bound(k: Column, n: Column, sign: int, z: float = 1.96) -> Column:
    """Wilson's bound of the rate k / n: the lower one at sign -1, the upper one at 1."""
    return (k + z * z / 2 + sign * z * F.sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z)


def abbreviations(df: DataFrame, text: str, rate: float = 0.1) -> DataFrame:
    """token, kind of the tokens whose dots the corpus explains: counts over all documents.

    A token that closes a block of lines at less than `rate` of its dots is an
    abbreviation: before numbers, inside sentences, or before names (no word
    makes up half of what follows). One that closes blocks more often and is also followed by lower case
    can do both. A token that closes blocks and is otherwise followed by capitals
    is no abbreviation (kind ''), whatever the list of known ones says. Every rate
    is held against its 95 % confidence bound; a token too rare for one is left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for v in b.column(0):
                t = v.as_py()
                if t and "." in t:
                    dot_evidence(t, counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array([k[2] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["token", "follows", "word", "n"],
            )

    seen = df.select(text).mapInArrow(count, "token string, follows string, word string, n bigint")
    n = lambda k: F.coalesce(F.sum(F.when(F.col("follows") == k, F.col("n"))), F.lit(0))
    seen = seen.groupBy("token", "follows", "word").agg(F.sum("n").alias("n"))
    top = F.coalesce(F.max(F.when(F.col("follows") == "c", F.col("n"))), F.lit(0))
    by = seen.groupBy("token").agg(top.alias("top"), F.sum("n").alias("all"), n("e").alias("e"), n("l").alias("l"), n("n").alias("num"))
    least = lambda k: _bound(k, F.col("all"), -1)
    most = lambda k: _bound(k, F.col("all"), 1)
    inner, inside = F.col("l") + F.col("num"), most(F.col("e")) <= rate
    kind = (
        F.when(inside & (least(F.col("num")) >= 0.8), NUMBER)
        .when(inside & (least(F.col("l")) >= 0.5), NEVER)
        .when(inside & (most(F.col("top")) <= 0.5) & (most(inner) <= 0.5), NAME)
        .when((least(F.col("e")) > rate) & (least(inner) >= 0.3), END)
        .when((least(F.col("e")) > rate) & (most(inner) < 0.3), "")
    )
    return by.select("token", kind.alias("kind")).where("kind is not null")


#: Abbreviations of the corpus that a broadcast may hold.
BROADCAST = 100_000


def _shared(df: DataFrame, text: str, rate: float):
    """The corpus's abbreviations for the tasks, and the end marks that the list or a lost letter would overrule."""
    found = abbreviations(df, text, rate).where((F.col("kind") != "") | F.col("token").isin(*SEEDS) | F.col("token").contains("�")).take(BROADCAST + 1)
    if len(found) > BROADCAST:
        raise ValueError("too many abbreviations for a broadcast: lower `rate`")
    return df.sparkSession.sparkContext.broadcast({r["token"]: r["kind"] for r in found})


def dot_sources(df: DataFrame, text: str, rate: float = 0.1) -> DataFrame:
    """source, n: how many questions about the dot after a token the document, the corpus and the fixed list decided.

    'none': a digit, or a token that nobody knows; its shape and what follows decide.
    """
    shared = _shared(df, text, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources: Counter = Counter()
            for v in b.column(0):
                if t := v.as_py():
                    units(t, shared.value, sources)
            yield pa.RecordBatch.from_arrays([pa.array(list(sources), pa.string()), pa.array(list(sources.values()), pa.int64())], names=["source", "n"])

    return df.select(text).mapInArrow(run, "source string, n bigint").groupBy("source").agg(F.sum("n").alias("n"))


def split_sentences(df: DataFrame, id_column: str, text: str, rate: float = 0.1) -> DataFrame:
    """Id column, start_char, end_char: one row per sentence unit of every text.

    Offsets count code points from 0, the end is exclusive, blanks around a unit
    are outside it. Null, empty and blank texts have no unit; repeated ids and
    texts give repeated rows; other columns are dropped. Two passes over the
    texts: one counts the evidence of dots over the whole corpus, with sums
    combined before the only shuffle; the other splits each text by itself.

    A dot is judged by the text's own unambiguous occurrences of its token, then
    by the corpus, then by the fixed list (see `dot_sources` for their shares). Of
    the corpus the abbreviations are broadcast, and the end marks that the list or
    a lost letter would overrule; above the limit of size the operator refuses.
    The work on a text grows with its length.
    """
    shared = _shared(df, text, rate)
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = shared.value
        for b in batches:
            rows, starts, ends = [], [], []
            for i, v in enumerate(b.column(1)):
                t = v.as_py()
                if t:
                    for x, y in units(t, corpus):
                        rows.append(i)
                        starts.append(x)
                        ends.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[id_column, "start_char", "end_char"])

    return df.select(id_column, text).mapInArrow(run, f"`{id_column}` {id_type}, start_char bigint, end_char bigint")
