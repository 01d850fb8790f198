"""What the checks of round 3 found: work that the operators did more often than they need."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa

from regimen.llm import bpe, neardup, tokenfiles


def test_parts_of_words_are_remembered_and_not_the_words():
    """Words of known letters and marks cost no entry and no call of the library each."""
    spec = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    coder = tokenfiles.LibraryCoder(spec, 1, 2)
    cores, marks = [f"Wört{chr(97 + i)}" for i in range(20)], ["!" * (i + 1) for i in range(20)]
    texts = [" ".join(a + c + b for c in cores for b in marks) for a in marks]
    got = coder(pa.array(texts)).to_pylist()
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids + [1] for e in coder.library.encode_batch(texts, add_special_tokens=False)]
    assert sum(len(m.new) + len(m.old) for m in vars(coder).values() if isinstance(m, tokenfiles.Remembered)) == 40


def test_small_steps_are_not_a_file_for_each_partition(spark, monkeypatch):
    """Stars of few links go to a task a core, however many partitions a shuffle has."""
    files, written = [], neardup.written

    def seen(df, name="table", *more):
        out = written(df, name, *more)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(neardup, "written", seen)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.createDataFrame([(i, i + 1) for i in range(400) if i % 4 < 3], "a bigint, b bigint")
        got = {r.node: r.component for r in neardup.components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 4 for i in range(400) if i % 4}
    assert max(files) <= spark.sparkContext.defaultParallelism
