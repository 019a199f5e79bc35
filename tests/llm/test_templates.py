from conftest import documents, frame, words
from driftline.llm import templates

QUESTION = ("A train leaves the old station at 14:30 and travels 120 km to Paris where Anna waits for 3 hours before "
            "the next train takes Anna another 80 km, so how many km were travelled in total by Anna that day?")
OTHER = QUESTION.replace("14:30", "9:15").replace("120", "75").replace("Paris", "Oslo").replace("Anna", "Boris").replace("80", "64")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(df, bench):
    return {(r.doc_id, r.item_id): r for r in templates.leaks(df, bench).collect()}


def test_exact_and_reparameterised_leaks(spark):
    mixed = OTHER.replace("Boris waits", "Carla waits", 1).replace("by Boris", "by Dora", 1)
    rows = [(1, words(1, 40) + " " + QUESTION + " " + words(2, 30)), (2, words(3, 40) + ". " + OTHER), (3, words(4, 200)),
            (4, words(5, 9) + ". " + mixed), (5, QUESTION.lower().replace("anna", "she")), (6, "Boris " * 50), (7, " ".join(QUESTION.split()[:9]))]
    got = found(frame(spark, rows), items(spark, [(10, QUESTION), (11, words(50, 30))]))
    assert set(got) == {(1, 10), (2, 10), (5, 10)}
    assert not got[1, 10].changed and got[2, 10].changed and got[1, 10].slots_agree == 1.0


def test_whole_items_are_found_and_no_others(spark, docs):
    rows = documents()
    bench = [(i, words(3000 + i, 15 + i)) for i in range(20)]
    rows += [(500 + i, words(-i - 9, 30) + " " + bench[i][1] + "\n" + words(-i - 99, 25)) for i in range(20)]
    assert set(found(frame(spark, rows), items(spark, bench))) == {(500 + i, i) for i in range(20)}


def test_odd_items_and_rows(spark, docs, no_docs, clashing):
    bench = items(spark, [(None, "a b c d e f g h i"), (1, None), (2, ""), (3, "one two three"), (4, words(7, 67)), (4, words(7, 67)), (5, "12 13 14")])
    got = found(docs, bench)
    assert (7, 4) in got and {i for _, i in got} <= {3, 4}
    assert set(found(clashing.drop("h"), bench)) == set(got)
    assert found(no_docs, bench) == {} and found(docs, items(spark, [])) == {}
    kept = templates.without_leaks(clashing, bench)
    assert kept.columns == clashing.columns
    bad = {d for d, _ in got}
    assert kept.count() == sum(i not in bad for i, _ in documents())
    assert templates.without_leaks(docs, items(spark, [])).count() == docs.count()


def test_placeholders():
    seen = templates.Tokens()
    a, slots, _ = templates.template("It costs $5 in Rome and weighs 3 kg. Then 7% left, 5kg too".encode(), seen)
    b, _, _ = templates.template("It costs 1,200 in Bern and weighs 40 lb. Then 88% left, 12km too".encode(), seen)
    assert a.tolist() == b.tolist() and slots.sum() == 6
    assert templates.template(b"", seen)[0].size == 0


def test_slots_of_other_word_counts(spark):
    """Names of several words, joined units and spelled-out numbers move the rest of a question."""
    item = ("a train leaves the old station with Anna inside it and travels 120 km before it stops in Paris where she waits for "
            "more than 200 long minutes until the very last bus takes everyone back home")
    first = item.replace("Anna", "Mary Ann Smith").replace("120 km", "75km").replace("Paris", "New York")
    second = first.replace("200", "two hundred and ten")
    short = "please tell me how many apples did Alice buy today if each apple costs ten cents and she paid with one note"
    rows = [(1, words(1, 40) + ". " + first + " " + words(2, 30)), (2, second), (3, short.replace("Alice", "Mary Ann")), (4, words(9, 90))]
    got = found(frame(spark, rows), items(spark, [(10, item), (11, short)]))
    assert set(got) == {(1, 10), (2, 10), (3, 11)} and all(r.changed for r in got.values())
    assert got[1, 10].cover == 1.0
    seen = templates.Tokens()
    a, b = (templates.collapsed(*templates.template(t.encode(), seen)) for t in ("it has 120 km left", "it has 120km left"))
    assert [x.tolist() for x in a] == [x.tolist() for x in b]


def test_bands_join_segments(spark):
    """Half of the windows on each side of a longer slot, none of the halves enough alone."""
    text = words(70, 30).split()
    item = " ".join(text)
    cut = text[:11] + ["so", "to", "say"] + text[11:20] + ["as", "it", "were"] + text[20:]
    rows = [(1, " ".join(cut)), (2, " ".join(text[:11]))]
    assert set(found(frame(spark, rows), items(spark, [(10, item)]))) == {(1, 10)}


def test_copies_of_items_that_are_mostly_slots(spark):
    """Capitals, number lists and lists of names are found as they stand, also inside other sentences."""
    bench = [(1, "WHO WROTE THE PLAY ABOUT THE PRINCE OF DENMARK AND WHEN"), (2, "12 13 14"), (3, "3 7 15 31 63 127 255 511 1023 2047"),
             (4, "Alice Bob Carla Dora Emil Fritz Gerda Hans Ida"), (5, "Which Large River Flows Through The Old City Of Vienna")]
    rows = [(i, f"{words(i, 20)} {text} {words(-i, 20)}") for i, text in bench]
    rows += [(15, "Which Large River Flows Through The Old City Of Cairo?"), (16, "5 8 13 21 34 55 89 144 233"), (17, words(17, 60))]
    got = found(frame(spark, rows), items(spark, bench))
    assert {(i, i) for i, _ in bench} <= set(got) and {d for d, _ in got} <= {1, 2, 3, 4, 5, 15}
    assert not any(got[i, i].changed for i, _ in bench)
