"""Deep-shallow sorting of suffixes up to a fixed length.

Multikey quicksort orders suffixes by their first ``SHALLOW`` bytes, eight bytes
a symbol. Suffixes that still agree have a long common prefix; each such group is
ordered by a blind trie: only branching positions are kept, an insertion walks
down by the bytes at these positions, compares once with the leaf it meets and
puts the new branch where the two differ.
"""

from __future__ import annotations

import numpy as np

SHALLOW, WORD, SMALL = 16, 8, 4096


def words_at(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The eight bytes from each start as one big-endian number (zeros past the end)."""
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    out = np.zeros(len(starts), np.uint64)
    for k in range(WORD):
        out = (out << np.uint64(8)) | padded[np.minimum(starts + k, len(padded) - 1)]
    return out


def shallow_order(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their first SHALLOW bytes, and where a group of equal ones begins."""
    symbols = [words_at(data, starts + d) for d in range(0, SHALLOW, WORD)]
    out, heads = [], []
    todo = [(np.arange(len(starts)), 0)]
    while todo:
        rows, depth = todo.pop()
        if not len(rows):
            continue
        if depth == len(symbols):
            out.append(rows)
            heads.append(np.append(True, np.zeros(len(rows) - 1, bool)))
        elif len(rows) <= SMALL:
            keys = [s[rows] for s in symbols[depth:]]
            order = np.lexsort(keys[::-1])
            head = np.append(True, np.zeros(len(rows) - 1, bool))
            for k in keys:
                head[1:] |= k[order[1:]] != k[order[:-1]]
            out.append(rows[order])
            heads.append(head)
        else:
            keys = symbols[depth][rows]
            pivot = np.partition(keys[:: max(1, len(keys) // 255)], len(keys[:: max(1, len(keys) // 255)]) // 2)[len(keys[:: max(1, len(keys) // 255)]) // 2]
            todo.append((rows[keys > pivot], depth))
            todo.append((rows[keys == pivot], depth + 1))
            todo.append((rows[keys < pivot], depth))
    return (np.concatenate(out), np.concatenate(heads)) if out else (np.zeros(0, np.int64), np.zeros(0, bool))


def blind_trie(texts: list[bytes]) -> list[list[int]]:
    """Classes of equal texts (all of one length), in order; members in the order given."""
    size = len(texts[0])
    numbers = [int.from_bytes(t, "big") for t in texts]
    leaves: list[list[int]] = [[0]]
    # a node: [depth, {byte: node or leaf number}]
    root: list | int = 0
    for k in range(1, len(texts)):
        text, node = texts[k], root
        while not isinstance(node, int):
            node = node[1].get(text[node[0]], next(iter(node[1].values())))
        other = leaves[node][0]
        apart = numbers[k] ^ numbers[other]
        if not apart:
            leaves[node].append(k)
            continue
        depth = size - 1 - (apart.bit_length() - 1) // 8
        parent, key, node = None, 0, root
        while not isinstance(node, int) and node[0] < depth:
            parent, key = node, text[node[0]]
            node = node[1][key]
        leaves.append([k])
        if not isinstance(node, int) and node[0] == depth:
            node[1][text[depth]] = len(leaves) - 1
            continue
        branch = [depth, {texts[other][depth]: node, text[depth]: len(leaves) - 1}]
        if parent is None:
            root = branch
        else:
            parent[1][key] = branch
    out: list[list[int]] = []
    walk = [root]
    while walk:
        node = walk.pop()
        if isinstance(node, int):
            out.append(leaves[node])
        else:
            walk += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def equal_classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each suffix, the same for suffixes whose first ``length`` bytes agree, rising in suffix order."""
    out = np.zeros(len(starts), np.int64)
    order, head = shallow_order(data, starts)
    if not len(order):
        return out
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(order)))
    number = np.cumsum(head) * 1.0
    out_order = np.zeros(len(order), np.int64)
    raw = data.tobytes()
    extra = np.zeros(len(order), np.int64)
    begin = starts[order]
    for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        at = begin[a : a + n].tolist()
        if n == 2:  # a trie of two leaves is one comparison
            x, y = raw[at[0] : at[0] + length], raw[at[1] : at[1] + length]
            extra[a : a + 2] = (0, 0) if x == y else (0, 1) if x < y else (1, 0)
            continue
        for c, members in enumerate(blind_trie([raw[i : i + length] for i in at])):
            extra[[a + m for m in members]] = c
    rank = np.lexsort((extra, number))
    new = np.append(True, (number[rank][1:] != number[rank][:-1]) | (extra[rank][1:] != extra[rank][:-1]))
    out_order[rank] = np.cumsum(new) - 1
    out[order] = out_order
    return out
