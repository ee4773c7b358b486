"""A child of the genetic packing shares the bins that it keeps, and leaves its parents as they were."""

import random

from sluice.llm import packing


def test_children_share_bins_and_parents_stay():
    rng = random.Random(4)
    sizes = [rng.randint(1, 700) for _ in range(400)]
    parents = []
    for noise in (0.0, 0.2):
        p = packing.Bins(sizes, 2048)
        p.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 - noise * rng.random())))
        parents.append(p)
    before = [([list(own) for own in p.items], list(p.free), p.cost()) for p in parents]
    own = {id(x) for p in parents for x in p.items}
    for child in (packing.crossover(*parents, rng), packing.mutate(parents[0], rng)):
        assert sorted(i for b in child.items for i in b) == list(range(len(sizes)))
        assert child.free == [2048 - sum(sizes[i] for i in b) for b in child.items] and min(child.free) >= 0
        assert child.cost() == (len(child.items), -sum(((2048 - f) / 2048) ** 2 for f in child.free))
        assert any(id(b) in own for b in child.items)
    assert [([list(own) for own in p.items], list(p.free), p.cost()) for p in parents] == before
