import numpy as np
import pytest

from atoflow.llm import packing

from .helpers import ROWS, awkward, empty, words


def naive(lengths, capacities=packing.CAPACITIES):
    """Best fit by looking at every open bin."""
    caps, bins, left = sorted(capacities), [], sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        left -= n
        open_ = [(cap - sum(lengths[j] for j in own), -at) for at, (cap, own, at) in enumerate((c, o, k) for k, (c, o) in enumerate(bins))
                 if cap - sum(lengths[j] for j in own) >= n]
        if open_:
            room = min(open_)[0]
            at = max((last, k) for k, (c, o, last) in enumerate((c, o, stamp[k]) for k, (c, o) in enumerate(bins))
                     if c - sum(lengths[j] for j in o) == room)[1]
        else:
            cap = min((c for c in caps if c >= n), key=lambda c: (packing.cost(c) / min(c, max(n + left, 1)), c))
            bins.append((cap, []))
            at = len(bins) - 1
            if at == 0:
                stamp = {}
        bins[at][1].append(i)
        stamp[at] = max(stamp.values(), default=0) + 1
    return sorted((min(c for c in caps if c >= sum(lengths[i] for i in own)), tuple(sorted(lengths[i] for i in own))) for _, own in bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_a_look_at_every_open_bin(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(5.5, 1.1, 150).astype(int), 4096)
    lengths[:3] = 0
    bins, at, caps = packing.best_fit(lengths)
    got = sorted((int(caps[b]), tuple(sorted(lengths[bins == b].tolist()))) for b in range(len(caps)))
    assert got == naive(lengths.tolist())
    for b, cap in enumerate(caps):
        own = np.flatnonzero(bins == b)
        used = lengths[own].sum()
        assert used <= cap and cap == min(c for c in packing.CAPACITIES if c >= used)
        spans = sorted((at[i], at[i] + lengths[i]) for i in own)
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_opens_the_size_that_costs_least_a_token():
    # two halves of 512 fill it; a lone piece takes the size it fits in
    assert packing.best_fit(np.array([300]))[2].tolist() == [512]
    cheap_large = lambda c: 1.0 if c == 4096 else c
    bins, _, caps = packing.best_fit(np.array([1000, 1000, 1000, 1000]), price=cheap_large)
    assert set(bins) == {0} and caps.tolist() == [4096]
    dear_large = lambda c: c * c
    assert packing.best_fit(np.array([500, 500, 500]), price=dear_large)[2].tolist() == [512] * 3


def test_too_long_a_piece_raises():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([5000]))


@pytest.mark.parametrize("shard", [3, 50_000])
def test_every_token_is_packed_once(spark, shard):
    out = packing.pack(awkward(spark), shard=shard).toPandas()
    assert list(out.columns) == ["doc_id", "piece", "start", "n_tokens", "bin", "bin_offset", "capacity", "bin_tokens"]
    assert out["n_tokens"].sum() == sum(len(words(t)) for _, t in ROWS)
    for _, own in out.groupby("bin"):
        own = own.sort_values(["bin_offset", "n_tokens"])
        assert (own["bin_offset"].to_numpy() == np.cumsum(own["n_tokens"]) - own["n_tokens"]).all()
        used = own["n_tokens"].sum()
        assert (own["bin_tokens"] == used).all()
        assert (own["capacity"] == min(c for c in packing.CAPACITIES if c >= used)).all()
    long = out[out["doc_id"] == 7].sort_values("piece")
    assert long["start"].tolist() == [4096 * i for i in range(15)] and long["n_tokens"].sum() == 60_000
    assert (out["doc_id"].isna()).sum() == 2 and (out["doc_id"] == 5).sum() == 2


def test_empty_table(spark):
    assert packing.pack(empty(spark)).count() == 0
