import random

import pytest

from tracklattice.llm import sentences as S

MODEL = S.Model(
    final={"ครับ", "ค่ะ", "คะ"}, abbreviations={"*": {"Dr", "No", "p.m", "e.g", "z", "B", "г", "д", "د"}}, after_number={"*": {"Mai"}}, after_shout={"*": {"Records"}},
)


def split(text, lang=""):
    ends = S.sentence_ends(text, MODEL, lang)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize("parts", [
    ["Dr. Fox ran 3.5 miles.", "He slept…", "Was it late?", "Yes!"],
    ["At 2 p.m. Anna left.", "Plesta! Records signed her.", "We saw No. 5."],
    ["He asked “Why so loud?” and left.", "“Never!” said Tom.", "She wrote: “It ends.”", "The end."],
    ["(It was warm.)", "Wait … it was late. 🔥", "It ended so…", "He left."],
    ["Am 3. Mai schlief Otto.", "„Los!“, rief er.", "Das war z. B. gut."],
    ["«Ещё раз!» — крикнул он.", "В 2019 г. Иван пел."],
    ["« Encore ! » cria Max.", "Qui chante ?", "Max."],
    ["¿Quién canta?", "¡Otra vez!", "«¡Ya!», gritó Ana."],
    ["“再来一次！”王明喊道。", "他说：“很好。”", "速度是136.2拍……很慢。", "是吗？"],
    ["「もう一曲！」と彼は言った。", "Aは「遮る。」と書いた。", "（静かだ。）", "誰が？"],
    ["Τι ζεστή φωνή!", "Ποιος αλλάζει τη φωνή;", "Η φωνή."],
    ["ما أجمل الصوت!", "هل يفتح الصوت؟", "عند 70.5 نبضة، الصوت."],
    ["यह धुन है।", "क्या यह है?"],
    ["เบสกันช้าๆค่ะ", "ใครตามที่ Riga คะ", "ทำนองเบาครับ"],
])
def test_sentences(parts):
    assert split(" ".join(parts)) == parts


def test_layout():
    text = "Notes on Fox\r\n\r\nThe crew\nslept. It was\nlate:\n- one thing\n- two. things\n1) a\n2) b\n\n01. X – Y\n02. Z"
    assert split(text) == ["Notes on Fox", "The crew\nslept.", "It was\nlate:", "- one thing", "- two. things", "1) a", "2) b", "01. X – Y", "02. Z"]
    assert split("He ran to the bar at\n12. The end came.") == ["He ran to the bar at\n12.", "The end came."]


def test_long_quotations_words_and_entities():
    inner = "He ran. " * 200
    assert split(f"She wrote: “{inner}It ended.” The end.") == [f"She wrote: “{inner}It ended.”", "The end."]
    model = S.Model(abbreviations={"*": {"Hauptbahnhofstr"}})
    assert S.sentence_ends("Die Hauptbahnhofstr. Nord ist lang. Ende.", model) == [35, 41]
    assert split("He plays &lsquo;Fox&rsquo;? She sings &lsquo;Cat&rsquo;.") == ["He plays &lsquo;Fox&rsquo;?", "She sings &lsquo;Cat&rsquo;."]
    assert len(S.sentence_ends("A.B." * 100_000, MODEL)) == 1


def test_no_text():
    assert S.sentence_ends("", MODEL) == [] and S.sentence_ends(" \n\t ", MODEL) == [] and S.sentence_ends("Fox  \n", MODEL) == [3]


def test_very_long_text_without_marks():
    assert S.sentence_ends("word " * 50_000, MODEL) == [249_999]


def test_particles_and_collocations_are_learned(spark):
    rng = random.Random(1)
    thai = ["เบสกันช้าๆค่ะ", "ทำนองเบาครับ", "กลับ Riga ทำนองดังครับ", "เสียงดี Max กลับบ้านค่ะ"]
    german = ["Der Fuchs kam am 3. Mai nach Rom.", "Wer singt?", "Der Hund lief!", "Die Uhr war uralt.", "Die Katze fraß Brötchen."]
    texts = [" ".join(rng.choice(thai) for _ in range(5)) for _ in range(300)] + [" ".join(rng.choice(german) for _ in range(8)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "th" if i < 300 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = S.learn(df)
    assert model.is_final("ครับ") and model.is_final("ค่ะ") and not model.is_final("กลับ")
    assert model.follows_number("de", "Mai") and not model.follows_number("de", "Der")
    got = S.split_sentences(df, model).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert all(got[i] == (5 if i < 300 else 8) for i in range(360))


def test_likelihood_ratio(spark):
    df = spark.createDataFrame([(30, 100, 10, 1000), (10, 100, 100, 1000), (0, 100, 5, 1000)], "k long, n long, l long, m long")
    got = [r[0] for r in df.select(S.likelihood_ratio("k", "n", "l", "m")).collect()]
    assert got[0] > 80 and got[1] == 0.0 and got[2] == 0.0


def test_learned_lists_and_table(spark):
    rng = random.Random(0)
    kinds = ["Dr. Anna sleeps.", "The dog runs!", "The cat of Dr. Bob eats.", "Is it late?", "The end of p. 5 comes.", "He met Dr. Carl!", "He ran."]
    texts = [" ".join(rng.choice(kinds) for _ in range(7)) for _ in range(40)] + [None, "", "  "]
    df = spark.createDataFrame([(i, t, None if i % 2 else "EN", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n int")
    model = S.learn(df)
    assert model.is_abbreviation("en", "Dr") and not model.is_abbreviation("en", "sleeps")
    got = S.split_sentences(df, model).toPandas()
    assert len(got) == 40 * 7 and set(got.groupby("doc_id").size()) == {7}
    assert S.split_sentences(df.limit(0), S.learn(df.limit(0))).count() == 0
