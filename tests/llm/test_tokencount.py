import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import tokencount
from quillspan.llm.common import shared_dir
from tests.llm.fixtures import awkward, empty


def test_round_trip_over_the_corpus(spark):
    docs = awkward(spark)
    enc = tokencount.encoder(tokencount.VOCABULARY)
    expected = sorted(((r["doc_id"], len(enc.encode_ordinary(r["text"] or ""))) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in tokencount.token_counts(docs).collect()), key=repr) == expected
    assert tokencount.token_counts(empty(spark)).count() == 0


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_stitching_over_block_bounds(spark, monkeypatch, kind):
    monkeypatch.setattr(tokencount, "RUN", 3)
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    rng = np.random.default_rng(0)
    listed, truth = [], {}
    for k in range(4):
        counts = rng.choice([0, 0, 1, 3, 8, 9, 40, 200], 30).tolist() if k else []
        tokens = [t for c in counts for t in [*rng.integers(0, 9, c).tolist(), 99]] + [1] * (5 * k)
        path = f"{root}/{k}.bin"
        with store.open_output_stream(path) as f:
            f.write(np.array(tokens, kind).tobytes())
        listed.append((path, len(tokens)))
        truth |= {(path, i): c for i, c in enumerate(counts)}
    files = spark.createDataFrame(listed, "path string, n_tokens long")
    found = tokencount.scan(spark, folder, files, eod=99, block=8, kind=kind)
    assert {(r["path"], r["nth"]): r["n_tokens"] for r in found.collect()} == truth
    left = tokencount.tails(files, found).select(F.sum("n_left")).first()[0]
    assert left == 5 + 10 + 15


def test_ids_take_the_narrowest_numbers():
    assert tokencount.id_type(tokencount.VOCABULARY, tokencount.EOD) == "<u2"
    assert tokencount.id_type(tokencount.VOCABULARY, 1 << 16) == "<u4"
