"""What Python workers hold while they count n-grams, and after a task."""

import random
import re
import tracemalloc
from pathlib import Path

import pyarrow as pa

from sectorflow.llm import common, quality


class Caught:
    """In place of a DataFrame: keeps the function given to mapInArrow."""

    def __getattr__(self, name):
        def call(*args):
            if name == "mapInArrow":
                self.run = args[0]
            return self

        return call


def test_counting_n_grams_holds_little(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    docs = [" ".join(word() for _ in range(1500)) for _ in range(700)]  # 7 MB, some 4 million different n-grams
    batches = [pa.RecordBatch.from_arrays([pa.array(docs[i : i + 100]), pa.array(["en"] * 100)], ["text", "lang"]) for i in range(0, len(docs), 100)]
    held = Caught()
    quality.count_grams(held)
    tracemalloc.start()
    try:
        n = sum(sum(b.column(2).to_pylist()) for b in map(lambda b: b.slice(0, 10), held.run(iter(batches))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 0 and peak < 150e6


def test_what_a_task_has_freed_goes_back():
    def anonymous():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    seen, pins = [], []

    def f(batches):
        blocks = [bytearray(b"x" * 60_000) for _ in range(2000)]
        pins.extend(blocks[::100])  # what is still in use between keeps the rest from going by itself
        del blocks
        seen.append(anonymous())
        yield from batches

    one = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    assert list(common.lean(f)(iter([one]))) == [one]
    assert anonymous() < seen[0] - 50
