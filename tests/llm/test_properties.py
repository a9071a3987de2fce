"""Property-based checks of the parts that need no cluster."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import byte_bpe, jpeg, line_dedup, quality, registry, simhash, warc
from tests.llm.test_pairs import plain_fingerprint


@pytest.fixture(scope="module")
def both():
    codec = byte_bpe.Codec(registry.VOCABULARY, public_tokenizers.PATTERN)
    return codec, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


TEXT = st.text(st.characters(blacklist_categories=("Cs",)), max_size=200)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_bpe(both, text):
    codec, library = both
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=5))
def test_jpeg(texts):
    payloads = [jpeg.padded(t) for t in texts]
    images = [jpeg.parse(m) for m in jpeg.encode(payloads)]
    assert [b"".join(t.tobytes() for t in jpeg.thumbnails(i)) for i in images] == payloads


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aAbB éÉ\t\n\x0b\x1c\xa0"), max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_near_fingerprints_share_a_key(fp, flips):
    other = fp ^ sum(1 << b for b in flips)
    a, b = (simhash.chain_keys(np.array([x], np.uint64))[0] for x in (fp, other))
    shared = np.intersect1d(a, b)
    pair = np.array([fp], np.uint64).repeat(len(shared)), np.array([other], np.uint64).repeat(len(shared))
    assert len(shared) and len(simhash.linked(shared, *pair))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=600), max_size=8))
def test_scores_do_not_depend_on_neighbours(texts):
    model = quality.new_model(np.random.default_rng(1))
    assert np.allclose(quality.scores(texts, model), [quality.scores([t], model)[0] for t in texts], atol=1e-6)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_line_keys(line):
    line = line.replace("\n", "")
    if any(0xD800 <= ord(c) < 0xE000 for c in line):
        return
    key = line.strip(" \t\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    assert line_dedup.key_of(line.encode()) == (key.encode() if len(key) >= 10 else None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=5), st.sampled_from([1, 2]))
def test_arc(blocks, version):
    import gzip

    records = [warc.ArcRecord(f"http://h/{k}", "0.0.0.0", "20260101000000", "text/html", b) for k, b in enumerate(blocks)]
    raw = warc.arc_version_block(version, "x") + b"\n" + b"".join(warc.arc_record(version, "x", r) + b"\n" for r in records)
    assert list(warc.read_arc(gzip.compress(raw))) == records
