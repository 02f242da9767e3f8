"""Plain versions that several tests use."""


def plain_groups(prints, radius=3):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]
