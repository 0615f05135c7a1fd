"""Gates of the validated memory: a nearest answer that is rejected is not replaced."""

from sparkquill.operators import memory


def test_gates(spark):
    near, far, other = [1.0, 0.1], [-1.0, 0.2], [0.0, 1.0]
    ddl = "vec_id long, embedding array<double>, question string, route string, stored string"
    stored = spark.createDataFrame([(1, near, "coste motor grande", "document_inventory", "a"), (2, [1.0, 0.3], "coste motor grande", "knowledge", "second"), (3, other, "ruedas azules", None, "x. Respuesta:  b "), (4, None, "coste", None, "z"), (5, [0.1, 1.2], "ruedas azules", "knowledge", "c")], ddl)
    asked = [(10, near, "coste motor grande"), (11, far, "coste motor grande"), (12, other, "ruedas rojas verdes"), (13, other, "ruedas azules"), (14, other, "de la"), (15, other, None), (16, None, "ruedas")]
    q = spark.createDataFrame(asked, "query_id long, q array<double>, question string")
    got = {r.query_id: (r.vec_id, r.verdict, r.answer) for r in memory.memory_lookup(q, stored.where("vec_id <> 4")).collect()}
    assert got[10] == (1, "route", None) and got[11][1] == "far" and got[11][2] is None
    assert got[12] == (3, "accepted", "b") and got[13] == (3, "accepted", "b") and got[14] == (3, "accepted", "b") and got[15] == (3, "accepted", "b")
    q = spark.createDataFrame([(20, other, "nada que compartir entre nosotros")], "query_id long, q array<double>, question string")
    row = memory.memory_lookup(q, stored.where("vec_id <> 4")).first()
    assert (row.vec_id, row.verdict, row.confidence) == (3, "words", None)
    assert memory.memory_lookup(q, stored.limit(0)).count() == 0
