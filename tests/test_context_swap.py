"""Swaps for shared context, on candidates made for them."""

from sparkquill.operators import context_swap

GROUPS = [[" 16 a ", " 16a "], [" 20 a "]]


def swapped(spark, *rows):
    data = [(1, f"c{i}", i, score, place, section, text, GROUPS) for i, (score, place, section, text) in enumerate(rows, 1)]
    df = spark.createDataFrame(data, "question_id long, chunk_id string, rank int, score long, place int, section string, text string, groups array<array<string>>")
    return {r.chunk_id: r.place for r in context_swap.context_swap(df).collect()}


ONE = (9, 1, "Proteccion", "El conductor principal de 20 A lleva aislamiento termoplastico")


def test_a_candidate_with_more_of_the_context_takes_the_weakest_place(spark):
    got = swapped(spark, ONE, (8, 2, None, "otro de 16 A sin nada"), (7, 3, None, "sin valores"), (6, None, None, "un conductor de 16A con aislamiento termoplastico"))
    assert got == {"c1": 1, "c4": 2, "c3": 3}


def test_without_one_in_the_selection_the_last_place_is_given(spark):
    got = swapped(spark, ONE, (8, 2, None, "nada"), (7, 3, None, "sin valores"), (6, None, None, "un conductor de 16 A"))
    assert got == {"c1": 1, "c2": 2, "c4": 3}


def test_as_many_shared_words_are_no_reason_and_far_words_do_not_count(spark):
    got = swapped(spark, ONE, (8, 2, None, "conductor de 16 A"), (6, None, None, "un conductor de 16 A"))
    assert got == {"c1": 1, "c2": 2}
    far = (9, 1, None, "de 20 A " + "x y " * 100 + "aislamiento termoplastico")
    assert swapped(spark, far, (8, 2, None, "otro de 16 A"), (6, None, None, "16 A aislamiento termoplastico")) == {"c1": 1, "c2": 2}


def test_neither_values_nor_selection(spark):
    assert swapped(spark, (9, 1, None, None), (8, None, None, "16 A")) == {"c1": 1}
    assert swapped(spark, (9, None, None, "16 A")) == {}
