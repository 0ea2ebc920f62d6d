"""Connected components in plain Python, for tests of grouping operators."""


def roots_of(links):
    """Smallest node reachable from each linked node."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_roots_of_chains():
    assert roots_of([(3, 2), (5, 3), (9, 8)]) == {2: 2, 3: 2, 5: 2, 8: 8, 9: 8}
