import hashlib
import random
import zlib

import numpy as np
import pytest

from quern.llm import media


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(random.Random(1).randbytes(500), dtype=np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (2 * h + int(media.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert media.gear_hashes(data).tolist() == want


def test_cuts_depend_on_content_and_join_back():
    r = random.Random(2)
    body = r.randbytes(60_000)
    files = [body, r.randbytes(777) + body, b"", b"x", bytes(40_000)]
    cuts = media.cut_points(files)
    for f, ends in zip(files, cuts, strict=True):
        chunks = media.split(f, ends)
        assert b"".join(chunks) == f and all(len(c) <= media.MOST for c in chunks) and all(len(c) >= media.LEAST for c in chunks[:-1])
    shared = set(media.split(files[0], cuts[0])) & set(media.split(files[1], cuts[1]))
    assert len(shared) >= len(cuts[0]) - 3


def test_container_is_checked():
    m = media.to_media(media.pad(b"abc"))
    assert media.from_media(m) == b"abc" + b"\xff" * 573
    for bad in (m[:-1], b"RIFX" + m[4:], m[:22] + b"\x02" + m[23:], m[:12]):
        with pytest.raises(media.MediaError):
            media.from_media(bad)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_round_trip(spark, docs, wide, rows, monkeypatch, broadcast_rows):
    r = random.Random(4)
    shared = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    more = spark.createDataFrame([(100 + k, shared[k * 100 :] + str(k), "en", "s", 1) for k in range(6)] + [(200, shared + shared, "en", "s", 1)], docs.schema)
    everything = [(x[0], x[1]) for x in rows] + [(x["doc_id"], x["text"]) for x in more.collect()]
    monkeypatch.setattr(media, "small", lambda df, **_: df.hint("broadcast") if broadcast_rows else df)
    got = media.media_features(docs.union(more)).collect()
    assert len(got) == len(everything)
    want = []
    for i, t in everything:
        b = (t or "").encode()
        p = media.pad(b)
        m = media.to_media(p)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), media.describe(p)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_chunks_are_stored_once(spark, docs):
    lists = media.materialize(media.chunk_lists(docs))
    shared = media.materialize(media.sharing(lists))
    stored = media.store(docs, shared).collect()
    held = [c["digest"] for s in {bytes(s["key"]): s for s in stored}.values() for c in {bytes(c["digest"]): c for c in s["chunks"]}.values() if c["place"] != media.ELSEWHERE]
    everything = {bytes(d) for x in lists.collect() for d in x["digests"]}
    assert len(held) == len(everything)


def test_empty(no_docs):
    assert media.media_features(no_docs).count() == 0
