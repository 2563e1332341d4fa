import subprocess
import sys

import pytest

# The pipeline's stages in Python, one after the other over 10 MB of text in one process, as in a
# worker: megabytes above the start, at most and after each.
CHILD = """
import threading, time
import numpy as np, pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.types import StructType
from revisit.llm import fertility, lattice, simhash

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()

class Docs:
    schema = StructType.fromDDL("doc_id long, text string")
    def select(self, *columns):
        return self
    def mapInArrow(self, run, schema):
        return run

def anonymous():
    with open("/proc/self/smaps_rollup") as lines:
        return next(int(x.split()[1]) for x in lines if x.startswith("Pss_Anon:")) / 1024

def watch():
    while True:
        most[0] = max(most[0], anonymous())
        time.sleep(0.005)

def batches(name):
    draw = np.random.default_rng(1)
    words = [bytes(w).decode() for w in draw.integers(97, 123, (20_000, 7)).astype(np.uint8)]
    for _ in range(4):
        picked = draw.integers(0, len(words), (1_000, 300))
        texts = [" ".join(words[i] for i in row) for row in picked]
        yield pa.record_batch({"doc_id": range(len(texts)), name: texts})

before, most = anonymous(), [0.0]
threading.Thread(target=watch, daemon=True).start()
for run, name in (
    (fertility.with_measures(Docs(), "m"), "text"),
    (simhash.fingerprints(Docs()), "text"),
    (lattice.encode_sampled(Docs()), "text to encode"),
):
    most[0] = 0.0
    for made in run(batches(name)):
        pass
    print(most[0] - before, anonymous() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_stages_hold_little_and_give_it_back():
    made = subprocess.run([sys.executable, "-c", CHILD], capture_output=True, text=True, check=True)
    figures = [tuple(map(float, line.split())) for line in made.stdout.splitlines()]
    assert len(figures) == 3
    # Slices of a megabyte and no trim: 128 to 178 at most, 90 to 132 after.
    assert all(most < 120 and after < 70 for most, after in figures)
