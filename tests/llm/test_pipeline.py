"""The pipeline against plain versions of its stages."""

import random
import re

import sentencepiece

import corpus_pipeline
from symgraph.llm import secret_scan, source_mix
from symgraph.llm.queries import piece_model
from tests.llm.common import docs, empty, rows
from tests.llm.test_operators import plain_codes, plain_groups


def test_pipeline(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).drop("position").collect()}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [tuple(r) for r in corpus_pipeline.rules(spark, frame, "").collect()]
    assert {r[0] for r in kept} <= {r[0] for r in rows()}
    groups = {i: c for i, _, c in plain_groups(kept)}
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    words = secret_scan.automaton()
    want = {}
    for r in kept:
        if r[0] is None or groups[r[0]] == r[0]:
            assert not secret_scan.scan(r[1], words) or re.search("=|:", r[1])
            want[r[0]] = (r[0], *plain_codes(sp, r[1]))
    assert got == want


def test_stages_return_the_columns_of_documents(spark):
    d = docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, "")
        assert d.columns == docs(spark).columns


def test_result_is_in_the_order_of_the_mixture(spark, tmp_path, monkeypatch):
    """Also where the mixture is written as several files of different sizes."""
    data = [(i, "word " * (1 + i * 7 % 50), "en", "a" if i % 5 else "bc"[i // 5 % 2], 0, 0, "") for i in range(1500)]
    docs(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
        mixed = source_mix.mix(docs(spark, data)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.doc_id, r.position) for r in out] == [(r.doc_id, i) for i, r in enumerate(sorted(mixed, key=lambda r: r.position))]


def test_empty_table(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def corpus():
    """Clean texts of three sources, near copies, secrets in texts that stay, and texts that the rules reject."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("river", "stone", "cloud", "meadow", "harbour", "winter") for b in ("side", "ing", "land", "s", "less", "ward", "er")]
    line = lambda: " ".join(rng.choices(vocabulary, k=12)).capitalize() + "."
    clean = ["\n".join(line() for _ in range(8)) for _ in range(160)]
    rows = [(i, t, "en", "a" if i % 4 else "bc"[i // 4 % 2], len(t), 1, "") for i, t in enumerate(clean)]
    rows += [(200 + i, clean[i] + " " + vocabulary[i], "en", "a", 1, 1, "") for i in range(5)]
    rows += [(300 + i, "\n".join([*(line() for _ in range(8)), f"The password = {'s3cr3tValue' * 2}{i} was written here by them all."]), "en", "b", 1, 1, "") for i in range(4)]
    return rows + [(400 + i, "too short", "en", "c", 1, 1, "") for i in range(3)]


def test_every_stage_takes_part(spark, tmp_path, monkeypatch):
    """The result against the stages one after the other, and that it is another one without any of them."""
    data = corpus()
    docs(spark, data).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    stages = corpus_pipeline.STAGES
    whole = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    ids = {r[0] for r in whole}
    assert ids == {r[0] for r in data if r[0] < 200 or 300 <= r[0] < 400}  # clean texts stay, near copies and rejected ones go
    order = [r[0] for r in whole]
    mixed = source_mix.mix(docs(spark, [r for r in data if r[0] in ids])).orderBy("position").collect()
    assert order == [r.doc_id for r in mixed] != sorted(order) and [r[4] for r in whole] == list(range(len(whole)))
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    text = {r[0]: r[1] for r in data}
    kept = {r[0]: tuple(r[1:4]) for r in whole}
    assert all(kept[i] != plain_codes(sp, text[i]) for i in range(300, 304)) and sum(kept[i] == plain_codes(sp, text[i]) for i in range(160)) == 160
    for left_out in range(4):
        monkeypatch.setattr(corpus_pipeline, "STAGES", [x for i, x in enumerate(stages) if i != left_out])
        assert [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] != whole, stages[left_out][0]
