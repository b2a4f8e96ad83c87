"""What operators hold in a worker's memory and leave on disk."""

from __future__ import annotations

import subprocess
import sys
import time
from pathlib import Path

import pytest

from pricewren.llm.common import written

#: Prints by how many MB at most a worker's memory grows while it works on one batch, beside the batch.
GROWTH = """
import ctypes, random, re
from pathlib import Path
import pyarrow as pa

def mb(name):
    return int(re.search(name + r":\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

rng = random.Random(3)
word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
texts = [" ".join(word() for _ in range(400)) for _ in range(2_500)]
def batch(texts):
    ids = pa.array(range(len(texts)))
    return pa.RecordBatch.from_arrays([ids, ids, ids, ids, pa.array(texts)], names=["id", "doc_id", "key", "key2", "text"])

{setup}
for _ in of(iter([batch(texts[:2])])):
    pass
all_ = batch(texts)
del texts
ctypes.CDLL(None).malloc_trim(0)
Path("/proc/self/clear_refs").write_text("5")
began = mb("VmRSS")
for _ in of(iter([all_])):
    pass
print(mb("VmHWM") - began)
"""
PACKING = "import public_tokenizers; from pricewren.llm import packing; of = packing._encoded(str(public_tokenizers.path('word_bpe_49k.json')), 1, 2048)"
SHINGLES = "from pricewren.llm import jaccard_join; of = jaccard_join._profile(5)"


@pytest.mark.parametrize(("setup", "most"), [(PACKING, 300), (SHINGLES, 34)])
def test_workers_stay_small(setup, most):
    out = subprocess.run([sys.executable, "-c", GROWTH.format(setup=setup)], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=200)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < most


def test_writing_leaves_no_shuffle_files(spark):
    def shuffled() -> int:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = shuffled(), spark.conf.get(name, None)
    table = written(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counts")
    deadline = time.time() + 20
    while shuffled() > before and time.time() < deadline:
        time.sleep(0.2)
    assert shuffled() <= before
    assert sum(r["count"] for r in table.collect()) == 1000 and spark.conf.get(name, None) == kept
