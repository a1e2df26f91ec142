"""Coverage by category, and the ledger of files that a folder holds."""

from agentscan.operators import ledger
from agentscan.sources import loaders


def test_states_by_category(spark):
    files = spark.createDataFrame(
        [("a", "skill", "read"), ("a", "skill", "read"), ("a", "source", "cut"), ("a", "manifest", "skipped"), ("b", None, "unread"), (None, "odd", "read")],
        "project_id string, artifact_type string, state string",
    )
    hits = spark.createDataFrame([("a", "supply"), ("b", "skill"), ("b", "skill"), ("b", None), ("c", "code"), ("a", "code")], "project_id string, category string")
    got = {(r.project_id, r.category): (r.state, r.files_read, r.files_cut, r.files_left, r.findings) for r in ledger.covered(files, hits).collect()}
    assert len(got) == 3 * len(ledger.CATEGORIES) + 1
    assert got["a", "skill"] == ("examined", 2, 0, 0, 0)
    assert got["a", "code"] == ("truncated", 0, 1, 0, 1)  # a finding doesn't make up for a cut file
    assert got["a", "supply"] == ("truncated", 0, 1, 1, 1)
    assert got["a", "network"] == ("truncated", 2, 1, 1, 0)
    assert got["a", "governance"] == ("not-examined", 0, 0, 0, 0)
    assert got["b", "network"] == ("not-examined", 0, 0, 1, 0)
    assert got["b", "skill"] == ("examined", 0, 0, 0, 2)  # a finding proves that something was read
    assert got[None, "network"] == ("examined", 1, 0, 0, 0) and got[None, "code"][0] == "not-examined"
    assert got["c", "code"] == ("examined", 0, 0, 0, 1)
    assert ledger.covered(files.where("false"), hits.where("false")).count() == 0


def test_every_category_that_is_read_is_catalogued():
    assert set(ledger.EVERY_TEXT) | {c for _, c in ledger.READS} == set(ledger.CATEGORIES)


def test_ledger_of_a_folder(spark, tmp_path):
    root = tmp_path / "corpus"
    for path, size in (("a/SOUL.md", 5), ("a/node_modules/x/package.json", 5), ("a/big.md", loaders.MOST_BYTES + 1), ("b/deep/er/SKILL.md", 3), ("b/empty.md", 0)):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"x" * size)
    got = {(r.project_id, r.path, r.size, r.state) for r in loaders.load_ledger(spark, str(root)).collect()}
    assert got == {("a", "a/SOUL.md", 5, "read"), ("a", "a/node_modules/x/package.json", 5, "skipped"), ("a", "a/big.md", loaders.MOST_BYTES + 1, "cut"), ("b", "b/deep/er/SKILL.md", 3, "read")}  # an empty file is not listed
    read = {r.path for r in loaders.load_artifacts(spark, str(root)).where("content is not null").collect()}
    assert read == {p for _, p, _, s in got if s == "read"}
