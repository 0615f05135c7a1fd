"""Each part of the relevance on a pair made for it, and pairs that it must leave alone."""

import pytest

from sparkquill.operators import relevance

PLAIN = {"question": "algo distinto", "text": "nada que ver", "section": None, "source": "x", "page": 9, "domain": None, "source_domain": None, "layer": None, "variant": None, "source_variant": None}
#: part, what of PLAIN is otherwise, points for candidates by vector
CASES = [
    ("overlap", {"question": "motor bomba", "text": "el motor y la bomba, motor"}, 2),
    ("keyword", {"question": "motor bomba gira", "text": "motores y bombas que giran"}, 4),
    ("core", {"question": "motor bomba", "text": "motores"}, 4),
    ("location_text", {"question": "donde esta motor", "text": "motores"}, 18),
    ("location_section", {"question": "donde esta motor", "section": "Motor"}, 22),
    ("page", {"question": "ver pag. 9"}, 50),
    ("page", {"question": "ver pag. 8"}, 0),
    ("exact_ref", {"question": "segun ITC-BT-07 y IT 1.2.", "text": "la ITC-BT-7 dice", "section": "IT 1.2"}, 56),
    ("exact_ref", {"question": "segun IT 1.2", "text": "IT 1.23 e IT 1.2.1"}, 0),
    ("anchor_section", {"question": "que dice el artículo 5", "section": "Artículo 5. Objeto"}, 24),
    ("anchor_section", {"question": "que dice el artículo 5", "section": "Artículo 5.1. Objeto"}, 0),
    ("table_kind", {"question": "cable de 16 A", "text": "tabla de cables"}, 14),
    ("numeric_intent", {"question": "cable de 16 A y 2,5 mm2", "text": "de 16 A o 2,5 mm2 o 216 a"}, 16),
    ("numeric_compact", {"question": "cable de 16 A", "text": "de 16A"}, 8),
    ("numeric_compact", {"question": "cable de 16 A", "text": "de 17A"}, 0),
    ("lone_number", {"question": "el 842 del 2002", "text": "real decreto 842"}, 18),
    ("number_group", {"question": "compara 16 A 20 A", "text": "son 16 a y 20 a"}, 44),
    ("group_context", {"question": "compara 16 A 20 A motor", "text": "16 a motor"}, 4),
    ("no_group", {"question": "compara 16 A 20 A", "text": "nada"}, -18),
    ("table_in_comparison", {"question": "compara 16 A 20 A", "text": "tabla con 16 a"}, -35),
    ("phrase", {"question": "Motor de bomba gira siempre", "text": "el motor de bomba"}, 80),
    ("application", {"question": "que normativa", "text": "se aplica y es obligatorio"}, 32),
    ("classification", {"question": "que normativa", "text": "clasificacion"}, 24),  # two words are in it
    ("itc", {"question": "la itc-bt-12", "text": "itc-bt-12 itc-bt-12"}, 70),
    ("itc_more", {"question": "la itc-bt-12 e itc-bt-13", "text": "itc-bt-12 e itc-bt-13"}, 20),
    ("scope_page", {"question": "el objeto", "page": 3}, 5),
    ("scope_section", {"question": "el objeto", "section": "Objeto y ambito"}, 7),
    ("motivation_page", {"question": "por que motivo", "page": 5}, 6),
    ("motivation_cue", {"question": "por que", "text": "con el fin de esto y para que aquello"}, 14),
    ("motivation_section", {"question": "por que", "section": "Preámbulo"}, 12),
    ("documentation", {"question": "documentacion", "text": "memoria tecnica y proyecto"}, 18),
    ("catalogue", {"question": "documentacion", "text": "catalogo de normas une"}, -10),
    ("whole_question", {"question": "El motor", "text": "dice: el motor."}, 6),
    ("definition", {"question": "que es motor", "text": "se entiende por motor; se define como"}, 20),
    ("definition", {"question": "motor", "text": "se entiende por motor"}, 0),
    ("list", {"question": "lista", "text": "a) uno b) dos"}, 6),
    ("summary", {"question": "resumen", "section": "Objeto"}, 5),
    ("table_word", {"question": "la tabla", "text": "tabla y tabla"}, 8),
    ("table_circuit", {"question": "la tabla", "text": "circuito C10"}, 8),
    ("comparison_cue", {"question": "compara", "text": "mayor que uno, mientras que otro"}, 12),
    ("procedure", {"question": "pasos", "text": "procedimiento y ejecucion"}, 10),
    ("temporal", {"question": "cuando", "text": "plazo de dias"}, 14),
    ("label", {"question": "de clase II tipo b", "text": "clase II, tipo c"}, 12),
    ("label_context", {"question": "de clase II", "text": "la clase II"}, 0),
    ("label_context", {"question": "motor clase II", "text": "x y", "section": "clase II"}, -10),
    ("numeric", {"question": "16 A", "text": "16 a"}, 6),
    ("low_signal", {"question": "16 A", "text": "sin cifras"}, -5),
    ("reference", {"question": "itc-bt-12", "section": "ITC-BT-12"}, 5),
    ("section", {"question": "motor", "source": "guia/motor"}, 8),
    ("section_title", {"question": "motor bomba", "section": "Motor y bomba"}, 12),
    ("section_title", {"question": "motor bomba", "section": "Motor"}, 0),
    ("source_title", {"question": "motor", "source": "guia/motor-2"}, 5),
    ("domain", {"domain": "en", "source_domain": "en"}, 12),
    ("foreign_domain", {"domain": "en", "source_domain": None}, -30),
    ("foreign_article", {"question": "articulo 5", "domain": "en", "source_domain": "fr"}, -30),
    ("layer_law", {"layer": "law"}, 8),
    ("layer_law", {"layer": "law", "question": "pasos"}, 0),
    ("layer_guide", {"layer": "manual", "question": "pasos"}, 4),
    ("layer_other", {"layer": "other"}, -5),
    ("variant", {"variant": "pdf", "source_variant": "pdf"}, 18),
    ("other_variant", {"variant": "pdf", "source_variant": "md"}, -10),
    ("it_section", {"question": "la IT 3.1", "section": "IT 3.1. Objeto"}, 20),
    ("article", {"question": "art. 05", "text": "el articulo 5 y el articulo 6"}, 26),
    ("toc", {"question": "articulo 1", "text": "articulo 1 articulo 2 articulo 3 articulo 4", "page": 2}, -90),
    ("comparison_overlap", {"question": "compara motor bomba", "text": "motor bomba"}, 3),
    ("no_core", {"question": "motor", "text": "x"}, -4),
    ("nothing", {"question": "motor", "text": "x"}, -6),
    ("specific_scope", {"question": "motor", "section": "Quirófano"}, -18),
    ("specific_scope", {"question": "motor en quirofano", "section": "Quirófano"}, 0),
]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [{"question_id": i, "chunk_id": str(i), **PLAIN, **changed} for i, (_, changed, _) in enumerate(CASES)]
    ddl = "question_id long, chunk_id string, question string, text string, section string, source string, page long, domain string, source_domain string, layer string, variant string, source_variant string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in ddl.split(", ")) for r in rows], ddl)
    return {r.question_id: r for r in relevance.relevance(df).collect()}, {r.question_id: r for r in relevance.relevance(df, lexical=True).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{i}-{c[0]}" for i, c in enumerate(CASES)])
def test_points_of_a_part(scored, i):
    part, _, points = CASES[i]
    assert scored[0][i][part] == points


def test_every_rule_has_a_case_and_scores_are_sums(scored):
    parts = [r.part for r in relevance.RULES]
    assert set(parts) == {c[0] for c in CASES} and len(parts) >= 40
    for rows, base in zip(scored, (0, relevance.LEXICAL_BASE)):
        assert all(r.score == base + sum(r[p] for p in parts) for r in rows.values())


def test_nulls_and_own_rules(spark):
    df = spark.createDataFrame([(1, "c", None, None, None, None, None, None, None, None, None, None)], "question_id long, chunk_id string, question string, text string, section string, source string, page long, domain string, source_domain string, layer string, variant string, source_variant string")
    assert relevance.relevance(df, rules=[relevance.Rule("mine", None, "pattern", " ", "d", 7, 1)]).first().score == 14
    assert relevance.relevance(df.limit(0)).count() == 0
