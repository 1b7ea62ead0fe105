from cortigraph.llm import leakage
from cortigraph.llm.mojibake import repair

ITEM = "In 383 the ordinary orchard of Nizabrima was described by Falorlordra and later sent to Quinwaverast for 876 coins."
MORE = "In 512 the silver orchard of Torbeck was described by Anselmo and later sent to Quarlin for 31 coins."
ZH = "532年，舟珩蘅翎把珩璟屿翎的古老的账本交给澜江霁璟，换来汀岫林江的55枚铜币和泊泊桐渡的书。"
SHORT = "Munlorzomo Todedoza 234 orchard Yagetesten Vibofenpe orchard Movorkanel?"


def run(spark, docs):
    items = [(1, ITEM, "en"), (2, MORE, "en"), (3, ZH, "zh"), (4, SHORT, "en"), (5, None, "en"), (6, "", None)]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(items, "item_id bigint, text string, lang string")
    return {(r["doc_id"], r["item_id"], r["kind"]) for r in leakage.leaked_items(d.select("doc_id", "text"), "doc_id", "text", e, "item_id", "text", "lang").collect()}


def test_forms_of_a_passage(spark):
    words = ITEM.split()
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM)
    docs = [
        (1, "Before. " + ITEM + " After."),
        (2, " ".join(words[3:15])),  # twelve words
        (3, " ".join(words[3:14])),  # eleven
        (4, ITEM.upper().replace(" ", "\n")),
        (5, ITEM.replace("described", "<b>des</b>cri­bed").replace(" the ", "&nbsp;th&#101; ")),
        (6, ITEM.replace("described", "desc-\nribed")),
        (7, wide),
        (8, ITEM.replace("Nizabrima", "Nizobrima").replace("876", "877").replace("later", "soon")),
        (9, None),
        (10, ""),
        (11, "x" + ZH[5:40].replace("，", " \n")),
        (12, ZH[5:20]),
        (13, "Menu\n\n" + SHORT.lower()),
        (14, SHORT.replace("234", "235")),
        (15, " ".join(reversed(words))),
    ]
    got = {(d, i) for d, i, kind in run(spark, docs) if kind == "verbatim"}
    assert got == {(1, 1), (2, 1), (4, 1), (5, 1), (6, 1), (7, 1), (11, 3), (13, 4)}


def test_other_values_must_be_consistent(spark):
    other = ITEM.replace("383", "99").replace("Nizabrima", "Velda").replace("Falorlordra", "Mirko").replace("Quinwaverast", "Ostra").replace("876", "12")
    got = run(spark, [(1, other), (2, "nothing of it")])
    assert (1, 1, "template") in got and not any(k == "verbatim" for *_, k in got)


def test_other_values_without_blanks(spark):
    ja = "タハスシは532年に古い橋のそばで灯りを55個数え、それからルラミキに渡して家へ帰った。"
    e = spark.createDataFrame([(1, ZH, "zh"), (2, ja, "ja")], "item_id bigint, text string, lang string")
    docs = [(1, ZH.replace("532", "41").replace("55", "7")), (2, ja.replace("タハスシ", "ミロ").replace("532", "1041").replace("55", "7")), (3, ja[:16]), (4, "没有。" + ZH[::-1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in leakage.leaked_items(d, "doc_id", "text", e, "item_id", "text", "lang").collect()}
    assert {(2, 2, "template")} <= got and {x[:2] for x in got} == {(1, 1), (2, 2)}


def test_run_behind_a_conflict():
    wording = frozenset("item and then came with many good words about the".split())
    ours = "item 3 and item 5 then came with many good words about the Bolo item and Rima then came with many good words about the 8 items".split()
    theirs = [{"3": "7", "5": "7", "Bolo": "Xu", "8": "9"}.get(w, w) for w in ours]
    item = leakage.Item(1, "en", " ".join(ours), slots := leakage.Slots(wording))
    words = [w.lower() for w in theirs]
    length, changed = leakage.filled_in(item, words, [slots.of(w)[1] for w in words], {})
    assert (length, changed) == (len(ours) - 2, 3)


def test_lost_and_wrong_letters(spark):
    item = "¿Cuántas de las 815 casas de Lanixakar compró Drahulwara después de que Modenisi dejó Lemanizel en 617?"
    d = spark.createDataFrame([(1, item.encode().decode("cp1252", "replace")), (2, item.encode("cp1252").decode("utf-8", "replace")), (3, item)], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, item, "es")], "item_id bigint, text string, lang string")
    out = leakage.leaked_items(d, "doc_id", "text", e, "item_id", "text", "lang")
    assert {r["doc_id"] for r in out.where("kind = 'verbatim'").collect()} == {1, 2, 3}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    e = spark.createDataFrame([], "item_id bigint, text string, lang string")
    assert leakage.leaked_items(d, "doc_id", "text", e, "item_id", "text", "lang").count() == 0


def test_repair_keeps_places():
    s, places = repair("a Ã© â€œb")
    assert s == "a é “b" and [places[i] for i in (0, 2, 4, 5)] == [0, 2, 5, 8] and places[-1] == 9
    assert repair("plain é text") == ("plain é text", None)


def test_items_may_be_stored_in_any_pieces(spark):
    items = [(i, f"In {100 + i} the ordinary orchard of Place{i} was described by Name{i} and later sent to Town{i} for {i} coins and {i} houses.", "en") for i in range(60)]
    e = spark.createDataFrame(items, "item_id bigint, text string, lang string")
    docs = [(i, items[i][1] if i % 2 else items[i][1].replace(f"Town{i}", "Velda").replace(f"Name{i}", "Mirko")) for i in range(0, 60, 7)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    run = lambda e: sorted(map(tuple, leakage.leaked_items(d, "doc_id", "text", e, "item_id", "text", "lang").collect()))
    assert run(e.repartition(1)) == run(e.repartition(13)) and len(run(e.repartition(3, "item_id"))) > len(docs)


def test_units_are_learnt(spark):
    e = spark.createDataFrame([(i, f"They gave {i} lanterns to the man and the lanterns of {i} men were red.") for i in range(9)] + [(9, "The old tower.")], "item_id bigint, text string")
    got = {r["hash"]: (r["n_items"], r["n"], r["n_counted"]) for r in leakage.word_counts(e, "text").collect()}
    of = lambda w: got[int(leakage._signed(leakage.np.array([leakage._hash(w)], leakage.np.uint64))[0])]
    assert of("lanterns") == (9, 18, 9) and of("men") == (9, 9, 9) and of("the") == (10, 19, 0) and of("tower") == (1, 1, 0)


def test_filter_holds_its_words(spark):
    words = [f"word{i}" for i in range(3000)]
    h = leakage._signed(leakage.np.array([leakage._hash(w) for w in words], leakage.np.uint64))
    f = leakage.Filter(*leakage.filter_of(spark.createDataFrame([(int(x),) for x in h], "hash bigint")))
    assert all(w in f for w in words) and sum(f"other{i}" in f for i in range(3000)) < 3
    assert f.holds(h.view(leakage.np.uint64)).all()


def test_one_item_verbatim_is_no_template_of_another(spark):
    items = [(i, f"In {100 + i} the ordinary orchard of Place{i} was described by Name{i} and later sent to Town{i} for {i} coins that the old man had.", "en") for i in range(8)]
    e = spark.createDataFrame(items, "item_id bigint, text string, lang string")
    decoy = "In 7 the ordinary orchard of Velda was closed and nobody came to see it before the spring of that year."
    d = spark.createDataFrame([(1, "Before. " + items[3][1] + " After."), (2, items[3][1].replace("Town3", "Velda")), (3, decoy)], "doc_id bigint, text string")
    got = [tuple(r)[:3] for r in leakage.leaked_items(d, "doc_id", "text", e, "item_id", "text", "lang").collect()]
    assert [x for x in got if x[0] == 1] == [(1, 3, "verbatim")]
    assert not [x for x in got if x[0] == 3] and (2, 3) in {x[:2] for x in got}
