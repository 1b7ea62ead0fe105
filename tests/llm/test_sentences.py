import pytest

from cortigraph.llm import sentences

CASES = [
    ["Dr. Dede recorded 78.21 units at 31 a.m. near the ferry.", "No. 50 on the list was copper."],
    ["They packed lamps, ropes, etc.", "Mrs. Lo vs. Feda Ltd. was heard on Jan. 5 here."],
    ["Did J. R. Paru open it?", "The lamp slowed... then it was warm.", "What a day!"],
    ["“Is it warm?” asked Rima from the ferry.", "\"Feluni left. Nobody asked why.\"", "In May, it rained."],
    ["\"Wait! It is not pale,\" said Magami quietly.", "See files.sapol.example/v33.9 for it (cf. Fig. 8).", "👍🏿 waved."],
    ["„Halt! Die Uhr fehlt“, rief Haboka am Dorf.", "Am 53. August kam Dr. X mit ca. 90,5 Kilo zum Bahnhof.", "„Wo ist Gageva?“", "Für viele ist z. B. die Uhr bzw. 3 Lampen usw. schöner."],
    ["¿Y si la Sra. Najali vive en la av. Nafeja, núm. 60?", "«¡Espera! No está lejana», dijo Fekosten.", "¡Qué señal!"],
    ["« Attends ! La étoile est précoce », dit Vifagol.", "Mme J.-P. Dege cite la p. 38 du livre.", "Pourquoi ?"],
    ["А. В. Борноже заплатил 46,2 тыс. руб. за то.", "«Стой! Где коробка?» — крикнул Шалимлим.", "См. рис. 48 и табл. 26.21 в книге."],
    ["डॉ. नुरारा ने 45.84 किलो का बाग गिना।", "\"रुको! पुल कहाँ है?\" रामेसा ने पूछा।", "कितना शांत!"],
    ["قال د. ديهامي إن الوزن 45.04 كيلو.", "«انتظر! أين بستان؟» سأل ريلو.", "لماذا؟"],
]
UNSPACED = [
    ["桐霁霁说：“等一下！灯笼还没好。”", "价格约90.30元，版本为57.35。", "他想了想……还是卖掉了。", "“快走！”砚岚舟在山谷喊道，手里拿着账本。"],
    ["「待って！鏡がない。」とタハスシは言った。", "ルラミキは『明るいやかん。』という本を数えた。", "それから……灯りを忘れた。", "なぜですか？"],
]


def pieces(text, corpus=None):
    return [text[a:b] for a, b in sentences.units(text, corpus or {})]


@pytest.mark.parametrize("want", CASES)
def test_spaced_scripts(want):
    assert pieces(" ".join(want)) == want
    assert pieces("\r\n".join(want)) == want


@pytest.mark.parametrize("want", UNSPACED)
def test_unspaced_scripts(want):
    assert pieces("".join(want)) == want


def test_blocks_thai_and_marks_without_blank():
    assert pieces("Home\nAbout\n\n Title\n \nIt ended.Why not?Yes!") == ["Home\nAbout", "Title", "It ended.", "Why not?", "Yes!"]
    assert pieces("ราคา 8 บาทสำหรับสมุด ทำไมโคมไฟ\nในตลาด") == ["ราคา 8 บาทสำหรับสมุด", "ทำไมโคมไฟ\nในตลาด"]
    assert pieces("") == [] and pieces(" \n \t") == []
    assert pieces('He said "no. Then he left.') == ['He said "no.', "Then he left."]


def test_wrongly_decoded_text_keeps_its_offsets():
    plain = "¿Y si vive en la av. Yata, núm. 17? ¡Qué día!"
    broken = plain.encode().decode("latin1")
    assert pieces(broken) == [x.encode().decode("latin1") for x in pieces(plain)]


def test_document_decides_unknown_abbreviations():
    assert pieces("It cost 4 xyz. for two. The xyz. Bolo was late.") == ["It cost 4 xyz. for two.", "The xyz. Bolo was late."]


def test_document_comes_before_corpus_and_list():
    for token in ("near", "approxim"):
        want = [f"It cost 4 {token}. for two.", f"The {token}. Bolo was late."]
        assert pieces(" ".join(want), {"near": ""}) == want
    assert pieces("They saw the fig again. Ana ate one fig. Bolo sat.", {"fig": sentences.NAME}) == ["They saw the fig again.", "Ana ate one fig.", "Bolo sat."]
    flat = "the lamp of the old river stood there for many days. it rained on the lamp and on all of the roofs.\n\nIt rained for many days. Bolo left."
    assert pieces(flat)[-1] == "Bolo left."


def test_corpus_is_judged_by_rates(spark):
    names = [(i, f"They met prezident. {chr(65 + i % 26)}olo{i} there." if i % 32 else "They met their prezident.") for i in range(640)]
    rare = [(i, f"Foo zz. {chr(65 + i)}olo sat.") for i in range(20)]
    kinds = {r["token"]: r["kind"] for r in sentences.abbreviations(spark.createDataFrame(names + rare, "doc_id bigint, text string"), "text").collect()}
    assert kinds["prezident"] == sentences.NAME and kinds["there"] == "" and "zz" not in kinds


def test_all_text_is_covered():
    for text in (" ".join(CASES[0]), "a. b! c? 5.5. X", "«a. B» c. D", "x" * 5000 + ". Y" * 500):
        assert "".join(pieces(text)).replace(" ", "") == text.replace(" ", "")


def test_frames_and_corpus(spark):
    rows = [(i, f"Foo qq. {chr(65 + i % 26)}olo{i} sat. The end was near.") for i in range(60)] + [(1, None), (2, ""), (None, "One. Two.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, start_char string")
    kinds = {r["token"]: r["kind"] for r in sentences.abbreviations(df, "text").collect()}
    assert kinds["qq"] == sentences.NAME and kinds["near"] == ""
    out = sentences.split_sentences(df, "doc_id", "text").collect()
    assert sum(r["doc_id"] == 5 for r in out) == 2 and sum(r["doc_id"] is None for r in out) == 2
    assert sentences.split_sentences(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("piece", ["A b. c. d ", "a-", "x.", "A.B.", "“ ", "-", "Etc. Bolo etc. Rima ", "a b c d\nE ", "No. ", "桐霁。", "He said \"no. ", ". " ])
def test_long_texts_take_time_by_their_length(piece):
    import time

    took = []
    for n in (20_000, 80_000):
        text = piece * (n // len(piece))
        counts = sentences.Counter()
        began = time.process_time()
        out = pieces(text, {"Etc": sentences.END})
        sentences.dot_evidence(text, counts)
        took.append(time.process_time() - began)
        assert "".join("".join(out).split()) == "".join(text.split())
    assert took[1] < 10 * took[0] + 0.5


def test_long_tokens():
    token = "Oberlandesgerichtspräsidentenstellvertreter"
    want = [f"It cost 4 {token}. for two.", f"The {token}. Bolo was late."]
    assert pieces(" ".join(want)) == want


def test_unpaired_marks_beside_pairs():
    assert pieces("“One “two. Three” four. Five. Six") == ["“One “two.", "Three” four.", "Five.", "Six"] or pieces("“One “two. Three” four. Five. Six") == ["“One “two. Three” four.", "Five.", "Six"]
    assert sentences.quote_spans("“a “b” c") == [(3, 5)] and sentences.quote_spans("„a “b ”c") == [(0, 3)] and sentences.quote_spans("“a “b” c”") == [(0, 8)]


def test_sources_of_decisions(spark):
    df = spark.createDataFrame([(1, "It cost 4 xyz. for two. The xyz. Bolo was late."), (2, "Dr. Bolo left."), (3, None)], "doc_id bigint, text string")
    got = {r["source"]: r["n"] for r in sentences.dot_sources(df, "text").collect()}
    assert got["document"] >= 1 and got["list"] >= 1
