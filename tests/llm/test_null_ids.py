"""Near copies among rows without ids."""

from tarmac.llm import near_dups


def test_one_of_near_copies_without_ids_stays(spark):
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words, f"x{k}"]) for k in range(4)]
    other = " ".join(f"v{k}" for k in range(40))
    rows = [*[(None, t) for t in near], (None, other), (None, ""), (5, "one two three four five six")]
    stay = near_dups.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text in near for r in stay) == [False, False, False, True]
    assert {r.text for r in stay} - set(near) == {other, "", rows[-1][1]}
