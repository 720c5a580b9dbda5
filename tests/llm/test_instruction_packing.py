"""Packing of conversations, in which only replies bear loss, and the packer against a plain one."""

import zlib

import numpy as np
import pytest

from folioscan.llm import chat_format, packing

SF = "/root/testdata/sf0.001"


def plain_packer(demands, limits):
    """Bin by bin: of all pieces that fit the one with the largest dot product of demand and room, both in shares of the limits."""
    left, bins, n = list(range(len(demands))), {}, 0
    key = lambda i: tuple(-int(x) for x in demands[i])
    for i in [i for i in left if demands[i][0] == limits[0]]:
        bins[i], n = n, n + 1
        left.remove(i)
    while left:
        room = [int(x) for x in limits]
        while True:
            fits = [i for i in left if all(d <= r for d, r in zip(demands[i], room, strict=True))]
            if not fits:
                break
            score = {}
            for i in fits:
                s = demands[i][0] / limits[0] * (room[0] / limits[0])
                for k in (1, 2):
                    s += demands[i][k] / limits[k] * (room[k] / limits[k])
                score[i] = s
            top = max(score.values())
            best = min((i for i in fits if score[i] == top), key=lambda i: (key(i), i))
            bins[best] = n
            left.remove(best)
            room = [r - int(d) for r, d in zip(room, demands[best], strict=True)]
        n += 1
    return [bins[i] for i in range(len(demands))]


@pytest.mark.parametrize("caps", [(100, 100, 100), (100, 4, 100), (100, 9, 35)])
def test_placement_equals_a_plain_packer(caps):
    rng = np.random.default_rng(4)
    for _ in range(12):
        n = int(rng.integers(1, 90))
        length = rng.choice([100, *range(1, 70)], n)
        demands = np.stack([length, np.ones(n, int), np.minimum(caps[2], (length * rng.random(n)).astype(int))], 1)
        bins, places = packing.pack_vectors(demands, np.array(caps))
        assert bins.tolist() == plain_packer(demands, np.array(caps))
        for b in set(bins.tolist()):
            assert sorted(places[bins == b].tolist()) == list(range((bins == b).sum())) and (demands[bins == b].sum(axis=0) <= caps).all()


def test_conversations_bear_loss_on_replies_only(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    encode = lambda x: t.encode(x, add_special_tokens=False).ids
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    want = {}
    for r in chat_format.format_conversations(rows).collect():
        at, ids, loss = 0, [], []
        for x in r.replies:
            for text, bears in ((r.formatted[at : x.lo], False), (r.formatted[x.lo : x.hi], True)):
                more = encode(text)
                ids += more
                loss += [bears] * len(more)
            at = x.hi
        more = encode(r.formatted[at:])
        want[r.conv_id] = ([*ids, *more, 0], [*loss, *[False] * len(more), False])
    tight = packing.Limits(tokens=300, segments=3, loss_tokens=60)
    packed = packing.pack_conversations(rows, path, 0, tight)
    pieces = packed.collect()
    for c, (ids, loss) in want.items():
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == c), key=lambda p: p.start):
            part = ids[at : at + p.length]
            assert (p.start, p.doc_tokens, p.loss, p.ids_crc32) == (at, len(ids), sum(loss[at : at + p.length]), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += p.length
        assert at == len(ids)
    assert {p.doc_id for p in pieces} == set(want)
    used = {}
    for p in pieces:
        used.setdefault(p.sequence_id, []).append((p.length, 1, p.loss))
    sums = [tuple(map(sum, zip(*x, strict=True))) for x in used.values()]
    assert all(a <= 300 and b <= 3 and c <= 60 for a, b, c in sums)
    binding = {r.limit: r.sequences for r in packing.fullest(packed, tight).collect()}
    assert sum(binding.values()) == len(sums) and binding.get("loss_tokens", 0) > 0  # here the limit on loss binds
    empty = rows.limit(0)
    assert packing.pack_conversations(empty, path).count() == 0
    odd = spark.createDataFrame([(1, 0, "assistant", None), (1, 1, "user", ""), (None, 0, None, "x")], "conv_id long, turn long, role string, text string")
    assert sorted((p.doc_id is None, p.loss) for p in packing.pack_conversations(odd, path).collect()) == [(False, 0), (True, 0)]
