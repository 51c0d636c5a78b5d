"""Pieces of a SentencePiece model, a double-array trie of them, and the lattice of a text's segmentations."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import numpy as np

MARK = "▁".encode()
NORMAL, USER, BYTE = 1, 4, 6


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = b[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _fields(b: bytes):
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        if key & 7 == 0:
            value, at = _varint(b, at)
        else:
            n, at = {1: (8, at), 5: (4, at)}.get(key & 7) or _varint(b, at)
            value, at = b[at : at + n], at + n
        yield key >> 3, value


def read_model(model: bytes) -> list[tuple[bytes, float, int]]:
    """(piece, score, kind) by id, from the bytes of a .model file."""
    out = []
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            score = float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0
            out.append((piece[1], score, piece.get(3, NORMAL)))
    return out


@dataclass
class Pieces:
    """What tasks need of a vocabulary; its size is that of the model file, whatever the corpus."""

    surface: list[bytes]  # by id; of a byte piece that byte
    score: np.ndarray  # natural log scores by id
    byte_id: np.ndarray  # 256 ids
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def load_pieces(model: bytes) -> Pieces:
    """The vocabulary of a model file. Scores of a unigram model are log probabilities and hold as they are.

    A merge-ranked vocabulary has the negative rank for a score; rank r then scores as Zipf's law has it, -log(r + 1) less
    the log of the harmonic sum. A byte piece scores 10 below the least of the others, as unknown characters do in unigram
    models.
    """
    rows = read_model(model)
    usable = [i for i, (_, _, kind) in enumerate(rows) if kind in (NORMAL, USER)]
    score = np.full(len(rows), -np.inf)
    given = np.array([rows[i][1] for i in usable])
    if len(given) and (given == np.round(given)).all() and given.min() < -100:
        given = -np.log(1 - given) - math.log(np.sum(1 / (1 + np.arange(len(given)))))
    score[usable] = given
    byte_id = np.full(256, -1, np.int64)
    for i, (piece, _, kind) in enumerate(rows):
        if kind == BYTE:
            byte_id[int(piece[3:5], 16)] = i
    if (byte_id < 0).any():
        raise ValueError("the model has no byte pieces")
    score[byte_id] = given.min() - 10
    surface = [p for p, _, _ in rows]
    for b, i in enumerate(byte_id):
        surface[i] = bytes([b])
    inside = [x for x in (rows[i][0].decode() for i in usable) if MARK.decode() in x.lstrip(MARK.decode())]
    if inside:
        raise ValueError(f"a piece has a marker after other characters: {inside[:3]}")
    return Pieces(surface, score, byte_id, *double_array({rows[i][0]: i for i in usable}))


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value of a double-array trie: byte b leads from state s to base[s] + b if check there is s.

    value is the id of the key that ends in a state, or -1. States are placed breadth first, each at a base
    at which all its children are free: an only child fills the first gap, others go behind the last that were placed so.
    """
    root: dict = {}
    for key, i in keys.items():
        node = root
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = i
    base, check, value, taken = [0], [-1], [-1], bytearray(1)
    taken[0], low, near, last = 1, 256, 256, 256
    todo = deque([(root, 0)])
    while todo:
        node, state = todo.popleft()
        value[state] = node.get(-1, -1)
        kids = sorted(k for k in node if k >= 0)
        if not kids:
            continue
        at = (low if len(kids) == 1 else near) - kids[0]
        while True:
            if (more := max(at, last) + 600 - len(taken)) > 0:
                taken.extend(bytes(more))
                base.extend([0] * more), check.extend([-1] * more), value.extend([-1] * more)
            if not any(taken[at + k] for k in kids):
                break
            at += 1
        if len(kids) > 1:
            near = at + kids[0]
        base[state] = at
        for k in kids:
            taken[at + k], check[at + k], last = 1, state, max(last, at + k)
            todo.append((node[k], at + k))
        while taken[low]:
            low += 1
    return tuple(np.array(x[: last + 257], np.int32) for x in (base, check, value))


def _rows(words: list[bytes], cells: int = 1 << 19):
    """Numbers of words of like lengths, and their bytes in a padded matrix with at most about `cells` cells."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        least = max(1, int(length[order[at]]))
        end = int(np.searchsorted(length[order], max(least + 3, least * 5 // 4), "right"))
        end = min(end, at + max(1, cells // max(1, int(length[order[end - 1]]))))
        pick = order[at:end]
        wide = int(length[pick[-1]])
        flat = np.frombuffer(b"".join(words[i].ljust(wide, b"\0") for i in pick), np.uint8).reshape(len(pick), wide)
        yield pick, flat, length[pick]
        at = end


def _arcs(p: Pieces, flat: np.ndarray, length: np.ndarray):
    """Every arc of the words' lattices, by start: (start, end, rows, ids), each call with one arc a row at most.

    A character that is no piece by itself gets an arc of its byte piece for each byte.
    """
    n, wide = flat.shape
    lead = (flat & 0xC0) != 0x80
    size = np.where(flat < 0x80, 1, np.where(flat >= 0xF0, 4, np.where(flat >= 0xE0, 3, 2)))
    raw = np.zeros((n, wide + 4), bool)
    for s in range(wide):
        rows = np.nonzero((length > s) & lead[:, s])[0]
        covered = np.zeros(n, bool)
        begun, node, t = rows, np.zeros(len(rows), np.int64), s
        while len(rows):
            to = p.base[node] + flat[rows, t].astype(np.int64)
            ok = p.check[to] == node
            rows, node, t = rows[ok], to[ok], t + 1
            ids = p.value[node]
            hit = ids >= 0
            if hit.any():
                at = rows[hit]
                covered[at[size[at, s] == t - s]] = True
                yield s, t, at, ids[hit]
            if t >= wide:
                break
            ok = length[rows] > t
            rows, node = rows[ok], node[ok]
        bare = begun[~covered[begun]]
        for k in range(4):
            raw[bare[size[bare, s] > k], s + k] = True
        rows = np.nonzero(raw[:, s] & (length > s))[0]
        if len(rows):
            yield s, s + 1, rows, p.byte_id[flat[rows, s]]


def best(p: Pieces, words: list[bytes]) -> list[np.ndarray]:
    """The ids of the best segmentation of each word by Viterbi's algorithm; of equal ones that with the longest last piece."""
    out: list = [None] * len(words)
    for pick, flat, length in _rows(words):
        n, wide = flat.shape
        top = np.full((n, wide + 1), -np.inf)
        top[:, 0] = 0
        came, by = np.zeros((n, wide + 1), np.int32), np.zeros((n, wide + 1), np.int32)
        for s, t, rows, ids in _arcs(p, flat, length):
            new = top[rows, s] + p.score[ids]
            ok = new > top[rows, t]
            rows = rows[ok]
            top[rows, t], came[rows, t], by[rows, t] = new[ok], s, ids[ok]
        at, steps = length.copy(), []
        every = np.arange(n)
        while at.any():
            live = at > 0
            steps.append(np.where(live, by[every, at], -1))
            at = np.where(live, came[every, at], 0)
        if not steps:
            steps = [np.full(n, -1)]
        ids = np.stack(steps[::-1], axis=1)
        ends = np.cumsum((ids >= 0).sum(axis=1))
        for i, x in zip(pick.tolist(), np.split(ids[ids >= 0].astype(np.int32), ends[:-1]), strict=True):
            out[i] = x
    return out


def marginal(p: Pieces, words: list[bytes]) -> np.ndarray:
    """The natural log of the summed probability of all segmentations of each word, by the forward recursion."""
    out = np.zeros(len(words))
    for pick, flat, length in _rows(words):
        n, wide = flat.shape
        total = np.full((n, wide + 1), -np.inf)
        total[:, 0] = 0
        for s, t, rows, ids in _arcs(p, flat, length):
            total[rows, t] = np.logaddexp(total[rows, t], total[rows, s] + p.score[ids])
        out[pick] = total[np.arange(n), length]
    return out


def expected(p: Pieces, words: list[bytes], n: np.ndarray) -> np.ndarray:
    """By piece id, how often the segmentations of the words hold the piece on average, each by its probability: forward and
    backward recursion. n says how often each word counts."""
    out = np.zeros(len(p.score))
    for pick, flat, length in _rows(words):
        arcs, every = list(_arcs(p, flat, length)), np.arange(len(pick))
        ahead, behind = np.full((len(pick), flat.shape[1] + 1), -np.inf), np.full((len(pick), flat.shape[1] + 1), -np.inf)
        ahead[:, 0], behind[every, length] = 0, 0
        for s, t, rows, ids in arcs:
            ahead[rows, t] = np.logaddexp(ahead[rows, t], ahead[rows, s] + p.score[ids])
        for s, t, rows, ids in reversed(arcs):
            behind[rows, s] = np.logaddexp(behind[rows, s], behind[rows, t] + p.score[ids])
        whole = ahead[every, length]
        held = [np.exp(ahead[rows, s] + p.score[ids] + behind[rows, t] - whole[rows]) * n[pick[rows]] for s, t, rows, ids in arcs]
        if held:
            out += np.bincount(np.concatenate([ids for _, _, _, ids in arcs]), np.concatenate(held), len(out))
    return out
