import struct
import zlib

import numpy as np
import pandas as pd

from claimloom.llm import media


def pgm(grey):
    g = np.clip(np.rint(grey), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (g.shape[1], g.shape[0]) + g.tobytes()


def png(grey):
    g = np.clip(np.rint(grey), 0, 255).astype(np.uint8)
    rows = b"".join(b"\0" + r.tobytes() for r in g)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", g.shape[1], g.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def pictures(n=12, seed=1):
    rng = np.random.default_rng(seed)
    return [media.resize(rng.uniform(0, 255, (8, 8)), 72, 72) for _ in range(n)]


def test_decoders():
    g = np.rint(pictures(1)[0])
    assert np.array_equal(media.decode(pgm(g)), g) and np.array_equal(media.decode(png(g)), g)
    rows = np.repeat(g.astype(np.uint8)[::-1, :, None], 3, axis=2).reshape(72, -1).tobytes()
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 72, 72, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert np.abs(media.decode(bmp) - g).max() < 0.01
    for bad in (None, b"", b"P5 9 9 255\n", b"junk", b"\x89PNG\r\n\x1a\nxx", b"BM"):
        assert media.decode(bad) is None


def test_places_round_trip():
    y, x, scale, angle = media.unpack_place(media.pack_place(12.3, 70.6, 0.5, -2.0))
    assert abs(y - 12.3) <= 0.13 and abs(x - 70.6) <= 0.13 and scale == 0.5 and abs(angle + 2.0) < 0.002


def test_copies_are_found(spark):
    rng = np.random.default_rng(2)
    rows, truth = [], {}
    for i, a in enumerate(pictures()):
        edits = [a, a, np.clip(a + rng.normal(0, 3, a.shape), 0, 255), a[6:66, 8:70], np.rot90(a), a * 0.8 + 20]
        for j, e in enumerate(edits):
            rows.append((i * 10 + j, png(e) if j % 2 else pgm(e)))
            truth[i * 10 + j] = i * 10
    got = {r["media_id"]: r["class_id"] for r in media.media_classes(spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    right = [got[k] == truth[k] for k in truth]
    assert np.mean(right) > 0.95 and all(got[k] // 10 == k // 10 for k in truth)


def test_many_copies_of_one(spark):
    a, rng = pictures(1)[0], np.random.default_rng(3)
    rows = [(i, pgm(np.clip(a + rng.normal(0, 2, a.shape), 0, 255))) for i in range(60)]
    got = media.media_classes(spark.createDataFrame(rows, "media_id long, media binary")).collect()
    assert {(r["class_id"], r["n_media"]) for r in got} == {(0, 60)}


def test_recall_of_edits():
    """Of each kind of edit, how many copies the tables find; and no link between unlike pictures by comparing all with all."""
    rng = np.random.default_rng(2)
    edits = {
        "noise": lambda a: np.clip(a + rng.normal(0, 8, a.shape), 0, 255), "crop": lambda a: a[a.shape[0] // 12 :, : a.shape[1] * 9 // 10], "quarter": lambda a: a[: a.shape[0] * 5 // 8, : a.shape[1] * 5 // 8],
        "turned": np.rot90, "dimmed": lambda a: a * 0.8 + 20, "smaller": lambda a: media.resize(a, a.shape[0] * 3 // 4, a.shape[1] * 3 // 4),
    }
    large = [media.resize(np.random.default_rng(500 + i).uniform(0, 255, (24, 24)), 216, 216) for i in range(8)]
    base = [media.describe(a) for a in [*pictures(20, 7), *large]]
    strings = [np.frombuffer(b"".join(f[4] for f in x), np.uint8).reshape(-1, 16) for x in base]

    def links(i, j, other, others, tables):
        bits = np.unpackbits(strings[i][:, None] ^ others[None], axis=2).sum(2) <= media.BITS
        if tables:
            bits &= (strings[i].copy().view(np.uint32)[:, None] == others.copy().view(np.uint32)[None]).any(2)
        x, y = np.nonzero(bits)
        return len(x) >= media.AGREE and media.agreeing([(*base[i][a][:4], *other[b][:4]) for a, b in zip(x, y, strict=True)]) >= media.AGREE

    for name, edit in edits.items():
        right = 0
        for i, a in enumerate([*pictures(20, 7), *large]):
            other = media.describe(np.rint(edit(a)))
            right += links(i, i, other, np.frombuffer(b"".join(f[4] for f in other), np.uint8).reshape(-1, 16), True)
        assert right >= 0.9 * len(base), (name, right)
    assert not any(links(i, j, base[j], strings[j], False) for i in range(20) for j in range(i))


def test_many_shapes_and_repeated_ids(spark):
    a, b = pictures(2)
    rows = [(1, pgm(a), 0), (2, pgm(a[:60]), 0), (3, pgm(b), 0), (3, pgm(b), 0), (4, pgm(b[:, :64]), 0), (5, pgm(a.T), 0), (6, pgm(np.tile(a, (1, 3))[:, :200]), 0)]
    got = media.media_classes(spark.createDataFrame(rows, "media_id long, media binary, img int")).collect()
    by = {r["media_id"]: r["class_id"] for r in got}
    assert len(got) == 7 and by[1] == by[2] == 1 and by[3] == by[4] == 3


def test_a_stack_is_described_as_its_images_are():
    stack = np.stack([np.rint(p) for p in pictures(5)])
    image, place, bits = media.describe_stack(stack)
    for i in range(5):
        alone = media.describe(stack[i])
        assert [d for *_, d in alone] == [d.tobytes() for d in bits[image == i]] and np.allclose(np.array([x[:4] for x in alone]), place[image == i])


def test_odd_rows(spark):
    a = pgm(pictures(1)[0])
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"junk"), (3, b"junk"), (None, a), (5, a), (6, pgm(np.zeros((4, 4)))), (7, pgm(np.zeros((80, 80))))], "media_id long, media binary")
    got = media.media_classes(df).collect()
    assert len(got) == 7 and {(r["media_id"], r["class_id"]) for r in got} == {(1, 1), (2, 1), (3, 3), (5, 5), (6, 6), (7, 7)}
    assert media.media_classes(df.where("1 = 0")).count() == 0
    assert media.draw(None) is None and media.draw([1.0, 2.0]) is None


def test_pairs_in_crowded_entries(spark, monkeypatch):
    """All images share one part of every descriptor and nothing else; only pairs of them are alike."""
    rng = np.random.default_rng(4)
    features = {}
    for i in range(20):
        words, flips = rng.integers(0, 1 << 31, (8, 3)), rng.integers(0, 31, (8, 3))
        places = [media.pack_place(9 * k, 7 * k % 50, 1.0, 0.0) for k in range(8)]
        for j in range(2):
            w = words ^ (j << flips)
            features[2 * i + j] = [{"geo": g, "d0": int(a) << 32 | 7, "d1": int(c) << 32 | int(b)} for g, (a, b, c) in zip(places, w.tolist(), strict=True)]

    def described(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "digest": pdf["id"].astype(str), "features": [features[i] for i in pdf["id"]]})

    monkeypatch.setattr(media, "_described", described)
    got = media.media_classes(spark.createDataFrame([(i, None) for i in features], "media_id long, media binary")).collect()
    assert {r["media_id"]: r["class_id"] for r in got} == {i: i // 2 * 2 for i in features} and {r["n_media"] for r in got} == {2}


def test_blocks_compare_all_pairs():
    """Links of blocks, halved ones too, connect what comparing every image with every other does."""
    rng, parts = np.random.default_rng(5), []
    for i, a in enumerate([e for p in pictures(14, 9) for e in (p, np.clip(p + rng.normal(0, 6, p.shape), 0, 255), p[: 60 - len(parts) % 9])]):
        _, place, bits = media.describe_stack(a[None])
        parts.append((i, np.array([media.pack_place(*x) for x in place.tolist()], np.int64), bits.view("<u8")))

    def block(some):
        return media._Block(np.array([i for i, _, _ in some]), np.array([len(g) for _, g, _ in some], np.int32), np.concatenate([g for _, g, _ in some]), np.concatenate([b for _, _, b in some]))

    def classes(links):
        up = {i: i for i, _, _ in parts}
        for u, v in links:
            up[media._find(up, u)] = media._find(up, v)
        return {frozenset(j for j in up if media._find(up, j) == media._find(up, i)) for i in list(up)}

    slow = []
    for i, g, x in parts:
        for j, h, y in parts[i + 1 :]:
            near = (np.bitwise_count(x[:, None] ^ y[None]).sum(2) <= media.BITS) & (x.copy().view("<u4")[:, None] == y.copy().view("<u4")[None]).any(2)
            m = [(*media.unpack_place(int(g[a])), *media.unpack_place(int(h[b]))) for a, b in zip(*np.nonzero(near), strict=True)]
            if media.agreeing(m) >= media.AGREE:
                slow.append((i, j))
    all_, one, two = block(parts), block(parts[::2]), block(parts[1::2])
    fast = [(a, b) for a in all_.halves() for b in (all_,)]
    whole = classes(slow)
    assert len(slow) > 20 and len(whole) < len(parts) and classes(media._links(all_, all_, media.BITS, media.AGREE, {})) == whole
    assert classes([link for a, b in fast for link in media._links(a, b, media.BITS, media.AGREE, {})]) == whole
    assert classes([link for a, b in ((one, one), (one, two), (two, one), (two, two)) for link in media._links(a, b, media.BITS, media.AGREE, {})]) == whole


def test_two_blocks_are_compared_in_one_turn():
    """Blocks whose images' numbers lie among each other give in one turn what they give in two, from the lesser image to the other; so do halves."""
    rng, blocks = np.random.default_rng(6), ([], [])
    for i, a in enumerate(pictures(24, 11)):
        for j, e in enumerate((a, np.clip(a + rng.normal(0, 6, a.shape), 0, 255), a[: 60 - i % 9])):
            _, place, bits = media.describe_stack(e[None])
            blocks[(i + j) % 2].append((7 * i + 3 * j % 7, np.array([media.pack_place(*x) for x in place.tolist()], np.int64), bits.view("<u8")))
    one, two = (media._Block(np.array([i for i, _, _ in b]), np.array([len(g) for _, g, _ in b], np.int32), np.concatenate([g for _, g, _ in b]), np.concatenate([x for _, _, x in b])) for b in blocks)

    def classes(links):
        up = {}
        for u, v in links:
            assert u < v
            up[media._find(up, u)] = media._find(up, v)
        return {frozenset(j for j in up if media._find(up, j) == media._find(up, i)) for i in list(up)}

    both = classes([link for a, b in ((one, two), (two, one)) for link in media._links(a, b, media.BITS, media.AGREE, {})])
    assert len(both) > 10 and classes(media._links(one, two, media.BITS, media.AGREE, {}, True)) == both
    assert classes([link for half in one.halves() for link in media._links(half, two, media.BITS, media.AGREE, {}, True)]) == both


def test_agreement_of_many_runs():
    """Runs of matches, tried no further than they can agree, are judged as agreeing() judges each."""
    rng = np.random.default_rng(7)
    n = rng.integers(1, 15, 3_000)
    p, q = (np.stack([rng.integers(0, 80, n.sum()) / 4, rng.integers(0, 80, n.sum()) / 4, rng.choice(media.SCALES, n.sum()), rng.choice([0.0, 0.5], n.sum())], axis=1) for _ in range(2))
    pixels = [(np.rint(x[:, 0]).astype(np.int64) << 21) + np.rint(x[:, 1]).astype(np.int64) for x in (p, q)]
    ends = np.cumsum(n)
    for agree in (1, 2, 4, 6):
        want = [media.agreeing(np.concatenate([p[e - m : e], q[e - m : e]], axis=1)) >= agree for e, m in zip(ends, n, strict=True)]
        assert media._Proposals(p, q, *pixels, n).agreeing(agree).tolist() == want and (agree == 1 or 0 < sum(want) < len(want))
