import math

import numpy as np
import pytest

from kairosight.llm import lbl_net as N


def small_head(setting, seed=0, size=60):
    rng = np.random.default_rng(seed)
    h = np.append(rng.integers(1, 1 << 62, size), np.array([N.END]).view(np.int64))
    count, own_class = np.append(rng.integers(1, 40, size), 9), np.append(rng.integers(0, 5, size), 0)
    by_class = np.bincount(own_class, count + 0.5, N.CLASSES)
    return N.head_of(h, count, own_class, by_class, int(count.sum()), len(count), setting)


class Fixed:
    """Tokens of one context and all choices."""

    def __init__(self, head, one, two, own):
        out, leaf, own_class = [], [], []
        for o in range(1, int(head.index.max()) + 1):
            out.append(o), leaf.append(head.base[0]), own_class.append(0)
        for k in range(N.CLASSES):
            for x in range(head.base[k], head.base[k + 1]):
                out.append(0), leaf.append(x), own_class.append(k)
        self.out, self.leaf, self.own_class = (np.array(x) for x in (out, leaf, own_class))
        self.one, self.two, self.own = (np.full(len(out), x) for x in (one, two, own))


def test_all_choices_together_have_probability_one():
    setting = N.Setting(vocabulary=20, least=3, members=4)
    model = N.Model(small_head(setting), setting)
    rng = np.random.default_rng(1)
    for t in model.tables.values():
        t += rng.normal(0, 0.5, t.shape).astype(np.float32)
    z = model.normalisers()
    own = int(model.head.leaf.max())
    for one, two, o in ((0, 0, 0), (25, 5, own), (len(model.tables["one"]) - 1, N.COARSE - 1, 0)):
        p = np.exp(model.log_probability(Fixed(model.head, one, two, o), z))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_every_frequent_word_is_learned_up_to_the_bound_of_its_class():
    setting = N.Setting(vocabulary=3, least=4, members=2)
    count, own_class = np.array([100, 90, 80, 9, 4, 3, 7, 5, 8]), np.array([0, 0, 0, 1, 1, 1, 2, 2, 2])
    head = N.head_of(np.arange(9) + 1, count, own_class, np.bincount(own_class, count + 0.5, N.CLASSES), int(count.sum()), 9, setting)
    learned = {int(c) for c, x in zip(head.count, head.leaf, strict=True) if x > 0}
    assert learned == {9, 4, 7, 8}
    assert head.mass[head.base[:3]] == pytest.approx([0.5, 3.5 + 0.5, 5.5 + 0.5])


def test_training_learns_rules_of_all_three_steps():
    """After output 1 comes output 2; after 3 class 1; in class 2 leaf follows context."""
    setting = N.Setting(vocabulary=4, least=1, members=9, batch=64, rate=0.1, tail_rate=0.1)
    head = small_head(setting)
    model = N.Model(head, setting)
    trainer, rng = N.Trainer(model, 0), np.random.default_rng(1)
    low, high = head.base[2], head.base[3]

    class X:
        pass

    def draw(n):
        x = X()
        x.one, x.two, x.own = rng.choice([1, 3, 4], n), np.zeros(n, int), np.zeros(n, int)
        x.out = np.where(x.one == 1, 2, np.where(x.one == 3, 0, rng.integers(0, 5, n)))
        x.own_class = np.where(x.one == 3, 2, rng.integers(0, 5, n))
        x.leaf = np.where(x.own_class == 2, np.where(x.one == 3, high - 1, rng.integers(low, high, n)), head.base[x.own_class])
        return x

    for _ in range(200):
        trainer.read(draw(128))
    model.tables = trainer.t
    x = X()
    x.one, x.two, x.own, x.out = np.array([1, 3, 4]), np.zeros(3, int), np.zeros(3, int), np.array([2, 0, 0])
    x.own_class, x.leaf = np.array([0, 2, 2]), np.array([head.base[0], high - 1, high - 1])
    p = np.exp(model.log_probability(x, model.normalisers()))
    assert p[0] > 0.8 and p[1] > 0.5 > 5 * p[2]


def test_changes_are_averaged_by_rows_met():
    setting = N.Setting(vocabulary=20, least=3, members=4)
    model = N.Model(small_head(setting), setting)
    parts = []
    for n, x in ((1, 4.0), (3, 8.0)):
        own = N.Trainer(model, 0)
        own.t["one"][7] += x
        own.met["one"][7] = n
        parts += own.changes()
    before = {k: v.copy() for k, v in model.tables.items()}
    N.load(model, [(parts[0][0], N.mean_change([p for _, p in parts], N.COLUMNS))])
    assert model.tables["one"][7] - before["one"][7] == pytest.approx(np.full(N.COLUMNS, 7.0), abs=0.01)
    assert all(np.array_equal(np.delete(model.tables[k], 7, 0) if k == "one" else model.tables[k], np.delete(before[k], 7, 0) if k == "one" else before[k]) for k in before)
    assert math.isfinite(float(model.normalisers().sum()))
