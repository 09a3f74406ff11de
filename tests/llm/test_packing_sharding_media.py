import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from auralake.llm import sharding
from auralake.llm.jpeg import encode_payloads, pad_payload, parse
from auralake.llm.media import media_columns, thumbnails
from auralake.llm.packing import pack
from auralake.llm.tokens import CachedTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_tokens_equal_the_library():
    whole, ours = Tokenizer.from_file(PATH), CachedTokenizer(PATH, 2)
    texts = ["", "Don't STOP, it's 3½ a²b _x_ é ß Ǆ", "<|endoftext|> mid<|startoftext|>", "中文 ok \U0001f600 Σας", "a\x85b\xa0c\x1cd", "x" * 3000]
    texts += [f"a{chr(c)}b {chr(c)}" for c in range(33, 0x300)]
    for t in texts:
        assert ours.encode(t)[:-1].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    assert ours.encode(None).tolist() == [2]


def check_pieces(rows, window):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return by_sequence, by_doc


def test_packing_places_every_id_once(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 500, int(n)))) for i, n in enumerate(rng.integers(0, 400, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = pack(docs, PATH, window=256, open_windows=4, max_gap=8).collect()
    sequences, by_doc = check_pieces(found, 256)
    encoder = CachedTokenizer(PATH, 2)
    ids = {i: encoder.encode(t) for i, t in rows}
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.astype("<u4").tobytes()) == r["ids_crc32"]
    for i, pieces in by_doc.items():
        assert sum(p[1] for p in pieces) == len(ids[i]) == pieces[0][2]
    assert set(by_doc) == set(ids)
    total = sum(map(len, ids.values()))
    assert len(sequences) * 256 <= total * 1.06 + 256


def plain_packing(lengths, window, most, gap):
    """The rule on lengths alone: {window contents} of one partition, each a list of (document, start, length)."""
    done, open_ones = [], []

    def room(w):
        return window - sum(n for _, _, n in w)

    def place(pieces, limit, top_up):
        for doc, start, n in pieces:
            while n > window:
                done.append([(doc, start, window)])
                start, n = start + window, n - window
            while n:
                fits = [w for w in open_ones if room(w) >= n]
                if fits:
                    best = min(fits, key=room)
                    best.append((doc, start, n))
                    n = 0
                elif len(open_ones) < limit:
                    open_ones.append(best := [(doc, start, n)])
                    n = 0
                else:
                    best = min(open_ones, key=room)
                    if room(best) <= top_up:
                        open_ones.remove(best)
                        done.append(best)
                        continue
                    k = room(best)
                    best.append((doc, start, k))
                    start, n = start + k, n - k
                if not room(best):
                    open_ones.remove(best)
                    done.append(best)

    place([(d, 0, n) for d, n in enumerate(lengths)], most, gap)
    rest = [p for w in sorted(open_ones, key=room) for p in w]
    open_ones.clear()
    place(rest, 1, 0)
    return done + open_ones


def test_packing_equals_the_plain_rule(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 500, int(n)))) for i, n in enumerate(rng.integers(0, 500, 150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    encoder = CachedTokenizer(PATH, 2)
    expected = plain_packing([len(encoder.encode(t)) for _, t in rows], 256, 4, 8)
    found = {}
    for r in sorted(pack(docs, PATH, window=256, open_windows=4, max_gap=8).collect(), key=lambda r: r["offset"]):
        found.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"], r["length"]))
    assert sorted(sorted(w) for w in found.values()) == sorted(sorted(w) for w in expected)


def test_packing_awkward_rows(awkward, empty):
    found = pack(awkward, PATH, window=128).collect()
    _, by_doc = check_pieces(found, 128)
    assert by_doc[3] == by_doc[4] == by_doc[5] == [(0, 1, 1)] and None in by_doc
    assert sum(length for _, length, _ in by_doc[6]) == 6
    assert pack(empty, PATH).count() == 0


def test_shards_are_even_and_gapless(spark, awkward, empty):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 97 AS INT)) AS text", "'c' AS shard")
    rows = sharding.shard_documents(docs, shards=24).collect()
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(24)]
    assert max(sizes) - min(sizes) < 0.01 * max(sizes)
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["size"] == r["doc_id"] % 97 + 8 and r["text_crc32"] == zlib.crc32(b"x" * (r["doc_id"] % 97)) for r in rows)
    assert sharding.shard_documents(awkward).count() == awkward.count() and sharding.shard_documents(empty).count() == 0


def test_rows_of_a_shard_follow_the_stored_map(spark, tmp_path):
    """The plain placement: the row's slot, the shard that the stored version names, and its rank there."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('y', CAST(id % 211 AS INT)) AS text")
    path = str(tmp_path / "map")
    rows = sharding.shard_documents(docs, shards=5, slots=64, map_path=path).collect()
    assert {r["map_version"] for r in rows} == {2} and sharding.load_map(spark, 1, path) == sharding.even_map(5, 64)
    mapping = sharding.load_map(spark, 2, path)
    assert len(mapping) == 64 and all(mapping[r["virtual_slot"]] == r["shard"] for r in rows)
    for s in range(5):
        ordered = sorted((r for r in rows if r["shard"] == s), key=lambda r: (r["virtual_slot"], r["doc_id"]))
        assert [r["slot"] for r in ordered] == list(range(len(ordered)))
    again = sharding.shard_documents(docs, shards=5, slots=64, map_path=path).collect()
    assert sorted(again) == sorted(rows)  # nothing to move: no new version
    grown = sharding.shard_documents(docs, shards=6, slots=64, map_path=path)
    after = sharding.load_map(spark, 3, path)
    assert grown.filter("map_version = 3").count() == 3000 and sum(after[k] != mapping[k] for k in after) < 16
    sizes = [r["b"] for r in grown.groupBy("shard").agg({"size": "sum"}).toDF("shard", "b").collect()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) < 0.15 * max(sizes)


def test_copies_of_one_text_are_spread(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same text', CAST(id AS STRING)) AS text")
    held = {r["shard"]: r["count"] for r in sharding.shard_documents(docs).filter("size = 21").groupBy("shard").count().collect()}
    assert len(held) == 24 and max(held.values()) < 3 * 2000 / 24


def test_map_versions(spark, tmp_path):
    sizes = {k: 10 + k % 7 for k in range(2000)}
    one = sharding.rebalance(sharding.even_map(8, 2000), sizes, 8)
    two = sharding.rebalance(one, sizes, 9)
    assert {two[k] for k in two if two[k] != one[k]} == {8}
    loads = [sum(sizes[k] for k in two if two[k] == s) for s in range(9)]
    assert abs(loads[8] - sum(loads) / 9) < 20 and max(loads) < 1.05 * sum(loads) / 8
    path = str(tmp_path / "map")
    assert sharding.latest_version(spark, path) == 0
    sharding.save_map(spark, one, 1, path)
    sharding.save_map(spark, two, 2, path)
    assert sharding.load_map(spark, 1, path) == one and sharding.load_map(spark, 2, path) == two
    assert sharding.latest_version(spark, path) == 2
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.save_map(spark, one, 1, path)


def test_media_round_trip(awkward, empty):
    rows = media_columns(awkward, keep_media=True).collect()
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = pad_payload(raw)
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and len(payload) % 576 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert bytes(r["media"][:2]) == b"\xff\xd8" and bytes(r["media"][-2:]) == b"\xff\xd9"
    same = [tuple(r)[1:] for r in rows if r["doc_id"] in (1, 2, None)]
    assert len(set(same)) == 1 and len(rows) == awkward.count() and media_columns(empty).count() == 0


def test_feature_equals_plain_cells(spark):
    """Width, height and the 64 cells brighter than their mean, cell by cell from the padded payload."""
    texts = ["", "short text", "mixed Text 0123 \xe9\u4e2d " * 90]
    rows = media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        payload = pad_payload(texts[r["doc_id"]].encode())
        image = [payload[i : i + 24] for i in range(0, len(payload), 24)]
        tall = len(image)
        tops = sorted({k * tall // 8 for k in range(8)})
        cells = []
        for a, b in zip(tops, [*tops[1:], tall], strict=True):
            cells += [[v for line in image[a:b] for v in line[c : c + 3]] for c in range(0, 24, 3)]
        means = [sum(c) / len(c) for c in cells]
        bits = [m > sum(means) / len(means) for m in means] + [False] * (64 - len(means))
        number = int("".join("01"[b] for b in bits), 2)
        assert r["feature"] == f"192x{tall * 8}:{number:016x}"


def test_every_byte_pair_survives():
    payload = np.random.default_rng(2).integers(0, 256, 576 * 9, dtype=np.uint8).tobytes() + bytes([0, 255] * 288) + b"\xff" * 576
    (stored,) = encode_payloads([payload])
    from auralake.llm.jpeg import dc_planes

    assert dc_planes(parse(stored))[0].tobytes() == payload


def test_general_baseline_image():
    """A hand-made image: two interleaved components, luminance sampled 2x1, AC coefficients present, no restarts."""
    import struct

    def seg(m, b):
        return struct.pack(">BBH", 255, m, len(b) + 2) + b

    # DC table: categories 0 (code 0) and 3 (code 10); AC: EOB (0), 0x02 run 0 size 2 (10)
    dc, ac = bytes([1, 1] + [0] * 14) + bytes([0, 3]), bytes([1, 1] + [0] * 14) + bytes([0, 2])
    bits = "".join(
        (
            "10" + "101" + "10" + "11" + "0",  # Y0: DC +5, AC 3, end
            "10" + "010" + "0",  # Y1: DC 5 - 5 = 0
            "0" + "0",  # Cb: 0
        )
    )
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    raw = (
        b"\xff\xd8" + seg(0xDB, bytes([0, 16] + [1] * 63)) + seg(0xC0, struct.pack(">BHHB", 8, 8, 16, 2) + bytes([1, 0x21, 0, 2, 0x11, 0]))
        + seg(0xC4, b"\x00" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    )
    from auralake.llm.jpeg import dc_planes

    (image,) = parse(raw)
    assert (image.width, image.height) == (16, 8)
    assert dc_planes([image])[0].tolist() == [[128 + 10, 128]]


def test_thumbnails_of_bad_bytes(spark):
    (good,) = encode_payloads([pad_payload(b"hello")])
    rng = np.random.default_rng(7)
    bad = {2: b"nope", 4: b"", **{100 + n: good[:n] for n in range(0, len(good), 3)}}
    for k in range(200):
        broken = bytearray(good)
        for at in rng.integers(2, len(good), 3):
            broken[at] = rng.integers(0, 256)
        bad[2000 + k] = bytes(broken)
    huge = bytearray(good)
    at = good.index(b"\xff\xc0") + 5
    huge[at : at + 4] = b"\xff\xff\xff\xff"
    rows = [(1, bytearray(good)), (3, None), (5, huge), *((k, bytearray(b)) for k, b in bad.items())]
    found = {r["doc_id"]: r for r in thumbnails(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert len(found) == len(rows) and found[1]["error"] is None and found[1]["thumb_width"] == 24 and found[1]["width"] == 192
    assert all(found[k]["error"] and found[k]["thumb"] is None for k in found if k in (2, 3, 4, 5) or 100 <= k < 2000)
    assert all((r["error"] is None) == (r["thumb"] is not None) for r in found.values())
