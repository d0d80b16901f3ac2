"""The source of files' beginnings: what it reads, what reaches it, and what stays with Spark."""

import pytest
from pyspark.sql import functions as F

from pagewright.sources import documents as docs
from pagewright.sources import heads, sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    heads.register(spark)
    root = tmp_path_factory.mktemp("heads")
    files = {"a.pdf": b"%PDF-1.7 and more", "b.pdf": b" \n" * 100_000 + b"%PDF" + b"x" * 500, "c.png": b"\x89PNG" + bytes(2_000_000), "empty.png": b"", "white.txt": b" \t" * 5, "sub dir/d%20.png": b"plain", "_left/e.png": b"out", ".f.png": b"out"}
    for name, content in files.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(content)
    return root


def found(spark, folder, where="true", **options):
    rows = spark.read.format("file_heads").options(**options).load(str(folder)).where(where)
    return {r.path.rsplit("/", 1)[-1]: r for r in docs.sniff(rows).collect()}


def test_rows(spark, folder):
    rows = found(spark, folder, filesPerTask=2)
    assert {k: (r.length, r.kind) for k, r in rows.items()} == {"a.pdf": (17, "pdf"), "b.pdf": (200_504, "pdf"), "c.png": (2_000_004, "image"), "empty.png": (0, "image"), "white.txt": (10, "image"), "d%20.png": (5, "image")}
    assert bytes(rows["b.pdf"].head) == b"%PDF" + b"x" * 60 and len(rows["c.png"].head) == 64 and bytes(rows["white.txt"].head) == b""
    assert bytes(found(spark, folder, headBytes=3)["a.pdf"].head) == b"%PD" and bytes(found(spark, folder, headBytes=0)["a.pdf"].head) == b""
    assert list(found(spark, f"file://{folder}/a.pdf")) == ["a.pdf"]
    (folder / "none").mkdir()
    assert found(spark, folder / "none") == {}


@pytest.mark.parametrize(
    ("where", "names"),
    [
        ("length > 17", {"b.pdf", "c.png"}), ("length >= 17 AND length <= 200504", {"a.pdf", "b.pdf"}), ("path LIKE '%.png' AND length < 6", {"empty.png", "d%20.png"}),
        ("length IN (0, 5)", {"empty.png", "d%20.png"}), ("path LIKE '%sub dir%'", {"d%20.png"}), ("length % 2 = 1 AND length < 100", {"a.pdf", "d%20.png"}), ("length = 10 OR path LIKE '%a.pdf'", {"white.txt", "a.pdf"}), ("length IS NULL", set()),
    ],
)
def test_conditions(spark, folder, where, names):
    assert set(found(spark, folder, where)) == names


def test_conditions_reach_the_source(spark, folder):
    """Files that fail a condition are not opened: one that cannot be read does no harm."""
    reader = heads.HeadsReader(str(folder), 64, 10)
    left = list(reader.pushFilters([heads.LessThan(("length",), 100), heads.StringEndsWith(("path",), ".pdf"), heads.EqualTo(("head",), b"")]))
    assert left == [heads.EqualTo(("head",), b"")]
    assert [f[0].rsplit("/", 1)[1] for part in reader.partitions() for f in part.files] == ["a.pdf"]
    plan = spark.read.format("file_heads").load(str(folder)).where("length < 100 AND path LIKE '%.pdf'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan


def test_files_written_twice(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k}.bin", bytes([k]) * k) for k in range(20)], "name string, content binary").repartition(3)
    for _ in range(2):
        sinks.write_files(rows, f"file://{tmp_path}/out")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"{k}.bin": bytes([k]) * k for k in range(20)}
