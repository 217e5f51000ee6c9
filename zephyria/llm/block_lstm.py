"""Recurrent block labeller: a bidirectional LSTM in numpy over a page's blocks."""

from __future__ import annotations

import zlib

import numpy as np

from zephyria.llm.html_parse import Block, Path

PATHS, LEAVES, WORDS = 1024, 512, 512
EMBEDDING, SCALARS, HIDDEN = 16, 6, 20
INPUT = 3 * EMBEDDING + SCALARS
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Share of word vectors left out at a time while fitting, so that paths are learned.
WORDS_OUT = 0.7
#: Blocks that are padded together at most; a longer page is labelled alone, so many blocks at a time.
CELLS = 16384
#: Blocks of one example; longer pages are learned from in several.
SEGMENT = 512


def bucket(word: str | bytes, size: int) -> int:
    return zlib.crc32(word.encode() if isinstance(word, str) else word) % size


def path_counts(path: Path) -> dict[int, int]:
    """How often each hashed word stands on the path."""

    def step(above: dict[int, int], element: tuple[str, ...]) -> dict[int, int]:
        counts = dict(above)
        for w in element:
            h = bucket(w, PATHS)
            counts[h] = counts.get(h, 0) + 1
        return counts

    return path.derived("counts", {}, step)


def leaf_counts(path: Path) -> dict[int, int]:
    """The same for its last two elements."""
    known = path.known.get("leaf")
    if known is None:
        known = path.known["leaf"] = {}
        for e in ((path.above.element if path.above else ()), path.element):
            for w in e:
                h = PATHS + bucket(w, LEAVES)
                known[h] = known.get(h, 0) + 1
    return known


class PageFeatures:
    """Hashed ids with their weights, and scalars, of blocks ``start`` on of a page of ``total`` blocks."""

    def __init__(self, page: list[Block], start: int = 0, total: int | None = None):
        ids, owner, counts, scalars = [], [], [], np.zeros((len(page), SCALARS), np.float32)
        total = len(page) if total is None else total
        for i, b in enumerate(page):
            for kind, known in enumerate((path_counts(b.path) or {0: 1}, leaf_counts(b.path) or {PATHS: 1})):
                ids += known
                counts += known.values()
                owner += [3 * i + kind] * len(known)
            words = b.text.encode().split()
            ids += [PATHS + LEAVES + zlib.crc32(w) % WORDS for w in words]
            counts += [1] * len(words)
            owner += [3 * i + 2] * len(words)
            n = len(b.text)
            scalars[i] = (np.log1p(len(words)) / 4, b.link_chars / n, b.text.count(".") / (1 + len(words)), min(b.path.depth, 64) / 8, (start + i) / total, 1)
        self.ids, self.owner, self.scalars = np.array(ids, np.int64), np.array(owner, np.int64), scalars
        count = np.array(counts, np.float64)
        self.weight = (count / np.bincount(self.owner, count, 3 * len(page)).clip(1)[self.owner]).astype(np.float32)

    def __len__(self) -> int:
        return len(self.scalars)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BlockLSTM:
    """Forward and backward cells over the block vectors, and a logistic unit on both."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        cell = lambda: draw(INPUT + HIDDEN, 4 * HIDDEN, scale=(INPUT + HIDDEN) ** -0.5)
        shift = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        self.w = weights or {
            "embedding": draw(PATHS + LEAVES + WORDS, EMBEDDING, scale=0.3),
            "ahead": cell(),
            "ahead_shift": shift.copy(),
            "back": cell(),
            "back_shift": shift.copy(),
            "out": draw(2 * HIDDEN + INPUT, scale=0.1),
            "bias": np.zeros(1, np.float32),
        }

    def vectors(self, page: PageFeatures, keep: np.ndarray | None = None) -> np.ndarray:
        part = self.w["embedding"][page.ids] * (page.weight if keep is None else page.weight * keep)[:, None]
        order = np.flatnonzero(np.diff(page.owner, prepend=-1))
        sums = np.zeros((3 * len(page), EMBEDDING), np.float32)
        sums[page.owner[order]] = np.add.reduceat(part, order)
        return np.hstack([sums.reshape(len(page), -1), page.scalars])

    def _run(self, x: np.ndarray, name: str, keep: bool, state: tuple | None = None):
        steps, batch, _ = x.shape
        w, shift = self.w[name], self.w[name + "_shift"]
        h, c = state or (np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32))
        hidden, kept = np.empty((steps, batch, HIDDEN), np.float32), []
        from_input = (x.reshape(-1, INPUT) @ w[:INPUT]).reshape(steps, batch, -1) + shift
        for t in range(steps):
            z = from_input[t] + h @ w[INPUT:]
            gate, new = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            before, last = c, h
            c = f * c + i * new
            squashed = np.tanh(c)
            h = o * squashed
            hidden[t] = h
            if keep:
                kept.append((last, before, i, f, o, new, squashed))
        return hidden, kept, (h, c)

    def _run_back(self, x: np.ndarray, name: str, kept: list, down: np.ndarray):
        w = self.w[name]
        grad, dx = np.zeros_like(w), np.empty_like(x)
        dh, dc = np.zeros_like(down[0]), np.zeros_like(down[0])
        shift = np.zeros(4 * HIDDEN, np.float32)
        for t in range(len(x) - 1, -1, -1):
            last, before, i, f, o, new, squashed = kept[t]
            dh = dh + down[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.hstack([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)])
            grad[:INPUT] += x[t].T @ dz
            grad[INPUT:] += last.T @ dz
            shift += dz.sum(axis=0)
            both = dz @ w.T
            dx[t], dh, dc = both[:, :INPUT], both[:, INPUT:], dc * f
        return grad, shift, dx

    @staticmethod
    def _flip(lengths: np.ndarray, steps: int) -> np.ndarray:
        """Index that turns each sequence around within its length."""
        t = np.arange(steps)[:, None]
        return np.where(t < lengths, lengths - 1 - t, t)

    def _forward(self, vectors: list[np.ndarray], keep: bool):
        lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
        x = np.zeros((int(lengths.max()), len(vectors), INPUT), np.float32)
        for b, v in enumerate(vectors):
            x[: len(v), b] = v
        flip, column = self._flip(lengths, len(x)), np.arange(len(vectors))
        ahead, kept_a, _ = self._run(x, "ahead", keep)
        turned = x[flip, column]
        back, kept_b, _ = self._run(turned, "back", keep)
        joined = np.concatenate([ahead, back[flip, column], x], axis=2)
        return joined, sigmoid(joined @ self.w["out"] + self.w["bias"]), (x, turned, flip, column, lengths, kept_a, kept_b)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable").tolist() if pages[i]]
        mine: list[int] = []
        for i in order:
            # pages come by length, so the next one is what the batch would be padded to
            if mine and (len(mine) == 64 or (len(mine) + 1) * len(pages[i]) > CELLS):
                self._label_batch(pages, mine, out)
                mine = []
            if len(pages[i]) > CELLS:
                out[i] = self._label_long(pages[i])
            else:
                mine.append(i)
        if mine:
            self._label_batch(pages, mine, out)
        return out

    def _label_batch(self, pages: list[list[Block]], mine: list[int], out: list[np.ndarray]) -> None:
        _, score, _ = self._forward([self.vectors(PageFeatures(pages[i])) for i in mine], False)
        for b, i in enumerate(mine):
            out[i] = score[: len(pages[i]), b] >= 0.5

    def _label_long(self, page: list[Block]) -> np.ndarray:
        """Both passes a segment at a time, the state handed on; of the backward pass a number a block is kept."""
        score, w = np.zeros(len(page), np.float32), self.w["out"]
        starts = range(0, len(page), CELLS)
        read = lambda a: self.vectors(PageFeatures(page[a : a + CELLS], a, len(page)))[:, None, :]
        state = None
        for a in reversed(starts):
            hidden, _, state = self._run(read(a)[::-1], "back", False, state)
            score[a : a + CELLS] = (hidden[::-1, 0] @ w[HIDDEN : 2 * HIDDEN])
        state = None
        for a in starts:
            x = read(a)
            hidden, _, state = self._run(x, "ahead", False, state)
            score[a : a + CELLS] += hidden[:, 0] @ w[:HIDDEN] + x[:, 0] @ w[2 * HIDDEN :]
        return sigmoid(score + self.w["bias"]) >= 0.5

    def gradients(self, pages: list[PageFeatures], labels: list[np.ndarray], rng: np.random.Generator) -> dict[str, np.ndarray]:
        kept = []
        for p in pages:
            words = p.owner % 3 == 2
            kept.append(np.where(words & (rng.random() < WORDS_OUT), 0, 1).astype(np.float32))
        joined, score, (x, turned, flip, column, lengths, kept_a, kept_b) = self._forward([self.vectors(p, k) for p, k in zip(pages, kept)], True)
        error = np.zeros_like(score)
        for b, y in enumerate(labels):
            error[: len(y), b] = (score[: len(y), b] - y) / len(y) / len(pages)
        out = np.einsum("tb,tbk->k", error, joined)
        down = error[:, :, None] * self.w["out"]
        ga, sa, dx_a = self._run_back(x, "ahead", kept_a, down[:, :, :HIDDEN])
        gb, sb, dx_b = self._run_back(turned, "back", kept_b, down[:, :, HIDDEN : 2 * HIDDEN][flip, column])
        dx = dx_a + dx_b[flip, column] + down[:, :, 2 * HIDDEN :]
        ids = np.concatenate([p.ids for p in pages])
        rows = [dx[: len(p), b, : 3 * EMBEDDING].reshape(-1, EMBEDDING)[p.owner] * (p.weight * k)[:, None] for b, (p, k) in enumerate(zip(pages, kept))]
        rows = np.concatenate(rows)
        embedding = np.stack([np.bincount(ids, rows[:, e], len(self.w["embedding"])) for e in range(EMBEDDING)], axis=1)
        return {"embedding": embedding.astype(np.float32), "ahead": ga, "ahead_shift": sa, "back": gb, "back_shift": sb, "out": out, "bias": error.sum(keepdims=True).ravel()}

    def fit(self, pages: list[PageFeatures], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 1) -> BlockLSTM:
        """Adam over batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        by_length = np.argsort([len(p) for p in pages], kind="stable")
        groups = [g for g in np.array_split(by_length, max(1, len(pages) // BATCH)) if len(g)]
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square, step = {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for epoch in range(epochs):
            rate = RATE * (1 - 0.8 * epoch / epochs)
            for g in rng.permutation(len(groups)):
                step += 1
                got = self.gradients([pages[i] for i in groups[g]], [labels[i].astype(np.float32) for i in groups[g]], rng)
                size = np.sqrt(sum(float((v**2).sum()) for v in got.values()))
                for k, v in got.items():
                    v = v * min(1.0, 1 / (size + 1e-9))
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    square[k] = 0.999 * square[k] + 0.001 * v * v
                    self.w[k] = self.w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)
        return self
