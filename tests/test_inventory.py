"""The inventory of projects on made documents: counts by hand, and the SQL."""

import duckdb
import pytest

from agentscan.operators import profiles

SCHEMA = "doc_id bigint, source string, text string"
#: (doc_id, source, text); the server file and the settings file of an id are one of six each.
DOCUMENTS = [
    (2, "many", "run curl x\nbash y\ncurl z"),
    (8, "many", "~/.ssh and curl"),
    (4, "declares nothing", "plain"),
    (10, "acts", "spawn('a')"),
    (5, "bare", None),
    (11, "bare", ""),
    (0, None, "curl"),
]


@pytest.mark.parametrize(
    ("documents", "want"),
    [
        # worst first; what a project lacks is 0; documents without a source join nothing
        (DOCUMENTS, [("many", 2, 4, 6, 3), ("acts", 1, 1, 2, 1), ("declares nothing", 1, 1, 2, 0), (None, 1, 0, 0, 0), ("bare", 2, 0, 0, 0)]),
        (DOCUMENTS[4:6], [("bare", 2, 0, 0, 0)]),
        ([], []),
    ],
)
def test_inventory(spark, tmp_path, documents, want):
    """It named capabilities found before, which no caller gives it, and failed on any input."""
    spark.createDataFrame(documents, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = profiles.q_inventory(spark, str(tmp_path))
    assert got.columns == ["project_id", "files", "servers", "dangerous", "capabilities"]
    assert [tuple(r) for r in got.collect()] == want
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(duck.execute(profiles.SQL_INV).fetchall(), key=repr) == sorted(want, key=repr)
