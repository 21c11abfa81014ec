"""Shingles that differ only in bits that aren't sent."""

import numpy as np
import pytest

from assetflow.llm import jaccard_join


@pytest.mark.parametrize(("buckets", "bits"), [(8, 3), (4096, 12), (65536, 16), (1 << 20, 16)])
def test_bucket_tells_high_bits_apart(buckets, bits):
    low = np.random.default_rng(6).integers(0, 1 << 48, 50).astype(np.uint64)
    for k in range(bits):
        two = np.concatenate([low, low ^ (np.uint64(1) << np.uint64(63 - k))])
        bucket = jaccard_join._bucket(two, buckets)
        assert bucket.min() >= 0 and bucket.max() < buckets
        got = jaccard_join.unpacked(np.frombuffer(jaccard_join.packed(two), np.uint8), bucket)
        assert len(np.unique(got)) == 100
