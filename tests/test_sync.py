"""A stored graph after random batches of changes against one built anew."""

import random
import shutil

from pyspark.sql import functions as F

from symgraph.plans import index

NAMES = ["alpha", "beta", "gamma", "delta"]


def source(rng, i):
    """A module that defines some of a few names, imports some from others and calls them, directly and on receivers."""
    other = rng.randrange(5)
    name = rng.choice(NAMES)
    out = [f"from m{other} import {name} as used, {rng.choice(NAMES)}", "", f"class {rng.choice(NAMES).title()}:", f"    def {rng.choice(NAMES)}(self) -> Alpha: return used()", ""]
    for f in rng.sample(NAMES, rng.randint(1, 3)):
        out += [f"def {f}(x: {rng.choice(NAMES).title()}):", f"    y = {rng.choice(NAMES).title()}()", f"    y.{rng.choice(NAMES)}()", f"    x.{rng.choice(NAMES)}()", f"    return {rng.choice(NAMES)}(used)", ""]
    return "\n".join(out)


def rows(spark, path, table):
    d = spark.read.parquet(f"{path}/{table}").drop("bucket")
    return sorted(map(str, d.select(*sorted(d.columns)).collect()))


def test_updates_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKETS", 3)
    rng = random.Random(12)
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for i in range(4):
        (src / f"m{i}.py").write_text(source(rng, i))
    index.build(spark, str(src), out)
    changes = []
    for i, gone in ((0, True), (1, False), (4, False)):  # one file goes, one changes, one is new
        f = src / f"m{i}.py"
        if gone:
            f.unlink()
            changes.append((f"file:{f}", "delete", None, 1))
        else:
            f.write_text(source(rng, i))
            changes += [(f"file:{f}", "upsert", "old text", 0), (f"file:{f}", "upsert", f.read_text(), 1)]
    batch = spark.createDataFrame([*changes, ("file:/other.txt", "upsert", "x", 0)], "path string, op string, content string, ts int")
    index.update(spark, out, str(src), batch)
    fresh = str(tmp_path / "fresh")
    index.build(spark, str(src), fresh)
    for table in ("nodes", "raw", "named", "variables", "bound", "edges", "files", "file_node_deps"):
        assert rows(spark, out, table) == rows(spark, fresh, table), table
    assert spark.read.parquet(f"{out}/edges").filter(F.col("type_context") != "").count() > 0
    shutil.rmtree(tmp_path / "out")
