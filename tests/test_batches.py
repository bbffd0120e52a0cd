"""What Python operators give back at once is bounded, however much they make of a text."""

import pyarrow as pa

from quern.functions import grammar
from quern.operators import python_backed


class Captured:
    """A frame that hands out the function given to mapInArrow."""

    dtypes = [("doc_id", "bigint"), ("text", "string")]

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_contexts_are_given_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(python_backed, "spread", lambda df: df)
    line = "Read the whole file first. " * 60
    text = "\n\n".join([line] * 200)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [text, "Ask when unsure.\n"]})
    for operator in (python_backed.clauses_in_context, python_backed.prose_contexts, python_backed.segmented):
        got = list(operator(Captured(spark))([batch]))
        assert max(b.nbytes for b in got) < 3 * python_backed.CHARS_OUT
        assert sum(b.num_rows for b in got) > 390 and got[-1].column(0)[-1].as_py() == 2
    assert len(list(python_backed.clauses_in_context(Captured(spark))([batch]))) > 10


def test_pieces_are_given_away_before_the_next_row_is_made():
    made = []

    def rows():
        for i in range(5):
            made.append(i)
            yield i, "x" * 10

    for k, piece in enumerate(python_backed.pieces(rows(), most=9, chars=20), 1):
        assert len(piece) <= 2 and len(made) == min(2 * k, 5)


def test_paths_in_step_are_those_of_each_unit():
    text = "# A\nOne here.\n## B\n\n**Bold label**\n\nTwo here.\n### C\n# D\nThree here.\n## E\n"
    units, heads = grammar.segment(text), grammar.headings(text)
    assert list(grammar.heading_paths(heads, units)) == [" > ".join(grammar.heading_path(heads, u.start, u.type == "heading")) for u in units]


def test_known_cases_keep_all_cores_for_documents(spark, tmp_path):
    """The documents are dealt to all cores, whatever the pieces of the small cases."""
    from quern.plans import catalogue

    path = f"{tmp_path}/documents.parquet"
    spark.range(8).selectExpr("id AS doc_id", "'Read this first.' AS text").coalesce(1).write.parquet(path)
    got = catalogue.queries()["g2_g10_grammar_cases"](spark, str(tmp_path)).where("name LIKE 'doc %'")
    assert len(set(got.selectExpr("spark_partition_id() AS p").toPandas()["p"])) > 1
