"""What a Python worker holds at once, beside the batch it was given."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from nearfield.llm import bpe, decontaminate, langid


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_decoding_holds_no_place_per_byte_of_a_block():
    decoder = bpe.BlockDecoder(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    ids = np.random.default_rng(1).integers(0, 50_000, 500_000).astype(np.int32)
    out = []
    assert peak_mb(lambda: out.append(decoder.decode(ids, np.array([200_000, 0, 300_000])))) < 40
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert out[0].to_pylist() == [b"".join(tokens[i] for i in ids[:200_000]), b"", b"".join(tokens[i] for i in ids[200_000:])]


def test_scan_for_benchmark_windows_holds_the_words_of_a_small_block():
    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 5000, 500))) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(range(3000)), pa.array(range(3000)), pa.array(texts)], ["key", "row", "th", "text"])
    bits = np.zeros(1 << decontaminate.BITMAP_BITS, bool)
    shared = type("Shared", (), {"value": np.packbits(bits).tobytes()})
    assert peak_mb(lambda: list(decontaminate._suspects(shared, [13])(iter([batch])))) < 40


def test_the_network_reads_few_words_at_a_time():
    words = [f"{i:048d}".encode() for i in range(4096)]
    predictor = langid.Predictor(langid.Network(["one", "two", "three", "four"]))
    assert peak_mb(lambda: predictor._read(words)) < 40
