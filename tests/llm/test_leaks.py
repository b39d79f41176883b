from tracklattice.llm import leaks as L

ITEM = "Explain how 6B turns 3A after 31 bars of clipped drop and patient mixer. Mark false any claim linking Maukzind with metallic pad or Fiseimdon Vandsak with Lichen Techno. Choose Cinder Funk when Bruxtru Kulek plus Diamglan Tazavrein demand feathered crate rather than dusty chord?"
OTHER = "Explain how 1B turns 9A after 77 bars of narrow loop and drowsy stab. Mark false any claim linking Joxgarn with severe cue or Palja Kulek with Hollow Bass. Choose Amber Step when Dinho Taxso plus Lurom Trasus demand vivid pad rather than hollow riff?"
JA = "仮にVivrol Drotbreが41枚の重いレコードをStausjoへ運びJoxgarnが静かに前奏を遮るなら。GeilpliのFiamtat Titseisが静かに追うレコードについて63.1と160.9の差を説明せよ。"
FILL = "The crew packed cables. Nobody heard the loop again and the needle stays warm all along tonight. "


def run(spark, docs, items=((1, ITEM), (2, OTHER), (3, JA), (4, None), (5, ""))):
    d = spark.createDataFrame([(i, t, "p") for i, t in enumerate(docs)], "doc_id long, text string, kind string")
    e = spark.createDataFrame(list(items), "item_id long, text string")
    got = L.leaked_passages(d, e).collect()
    return {(r["item_id"], r["doc_id"]) for r in got if r["kind"] == "passage"}, {(r["item_id"], r["doc_id"]) for r in got if r["kind"] == "template"}


def test_whole_altered_and_part(spark):
    half = ITEM[: int(len(ITEM) * 0.65)]
    foreign = ITEM.split(". ")
    docs = [
        FILL + ITEM + FILL, ITEM.upper(), half + FILL, ITEM.replace("a", "а"), ITEM.replace("bars", "barz").replace("patient", "patent"), (ITEM[:90] + " \n" + ITEM[90:]).replace("e", "e​"),
        foreign[0] + ". " + "Das ist ein fremder Satz mit einigen Wörtern darin. " + ". ".join(foreign[1:]), FILL + JA[:70], FILL * 300 + ITEM,
    ]
    passage, _ = run(spark, docs)
    assert {(1, i) for i in (0, 1, 2, 3, 4, 5, 6, 8)} | {(3, 7)} == passage


NAMES = ["Vivrol", "Drotbre", "Stausjo", "Geilpli", "Titseis", "Maukzind", "Fiseimdon", "Vandsak", "Kulek", "Tazavrein", "Joxgarn", "Palja", "Lurom", "Trasus", "Bruxtru", "Diamglan", "Zirnlern", "Nexdrei", "Glalfa", "Vruske"]


def question(names, n, unit="bars"):
    a, b, c, d = names
    return f"Explain how the mixer of {a} turns after {n} {unit} of noise. Mark false any claim linking {b} with a pad or {c} with the {n + 3}th record of {d}."


def questions():
    return [(i, question([f"{NAMES[(i * 4 + k * 3) % 20]}{'aeiou'[i % 5]}{'bdgkl'[i // 5]}" for k in range(4)], 10 + 7 * i)) for i in range(20)]


def test_a_question_asked_again_with_other_values_is_a_template(spark):
    docs = [FILL + question(["Ostrava", "Quimby", "Ruiz", "Nakano"], 4242, "seconds") + FILL, FILL + questions()[3][1], FILL + questions()[3][1][:60], FILL * 3]
    passage, template = run(spark, docs, questions())
    assert passage == {(3, 1)}
    assert {(i, 0) for i in range(20)} <= template and not {p for p in template if p[1] >= 2}


def test_short_quotes_are_none(spark):
    passage, template = run(spark, [FILL + ITEM[:70] + FILL, FILL + ITEM[130:190] + FILL, None, "", "  "])
    assert not passage and not template


def test_passages_come_through_template_windows(spark, monkeypatch):
    assert run(spark, [ITEM])[0] == {(1, 0)}
    keys = L._item_keys
    monkeypatch.setattr(L, "_item_keys", lambda items, frame: keys(items, frame).where("slots = 0"))
    assert run(spark, [ITEM])[0] == set()


def test_types():
    t = L.Templates(frozenset({"after", "of"}))
    code, _ = t.typed(L.tokens_of("after 31 bars of Maukzind bars"))
    assert code[1:3].tolist() == [L.NUMBER, L.UNIT] and code[4:].tolist() == [L.NAME, L.NAME] and code[0] > L.NAME


def test_frame_is_counted_over_all_items(spark):
    df = spark.createDataFrame(questions(), "item_id long, text string").repartition(7)
    frame = L.common_wording(L._item_tokens(df, "item_id", "text"))
    assert {"explain", "mixer", "claim"} <= frame and not {w for w in frame if w.startswith(("maukzind", "vivrol"))}


def test_empty_tables_repeats_and_a_passage_in_a_third_of_the_texts(spark):
    passage, _ = run(spark, [ITEM, ITEM])
    assert {(1, 0), (1, 1)} <= passage
    assert run(spark, [ITEM], items=[(4, None)]) == (set(), set())
    assert run(spark, [None], items=[(1, ITEM)]) == (set(), set())
    passage, _ = run(spark, [FILL + ITEM if i % 3 == 0 else FILL for i in range(600)])
    assert passage == {(1, i) for i in range(0, 600, 3)}
