"""Plain restatements of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_statistics(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    lines, n_dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(BLANKS):
            n_dup += line in lines
            lines.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), n_dup, len(repeated), failed


def line_dedup(rows):
    """[(doc_id, text)] to [(doc_id, n_lines, n_dropped, kept text)]."""
    def key(line):
        return line.strip(BLANKS).translate(LOWER)

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(holders[key(x)]) < 5 or doc_id == max(d for d in holders[key(x)] if d is not None)]
        out.append((doc_id, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def shingles(text, size=3):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < size else zip(*(words[i:] for i in range(size))))


def near_duplicates(rows, size=3, threshold=85):
    """[(row, text)] to {row: component}."""
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if s and t and 100 * len(s & t) >= threshold * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d, _ in sets}


def targets(sizes, weights=(1, 2, 3), epochs=3):
    """{source: words} to {source: target}, by giving out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: float(epochs * sizes[s]) for s in over})


def mix(docs, shuffled):
    """[(doc_id, source, words)] and each document's key in the shuffle to {source: (size, target)} and {doc_id: words taken}."""
    sizes, order, taken = Counter(), defaultdict(list), Counter()
    for doc_id, source, n in sorted(docs, key=lambda d: (*shuffled[d[0]], d[0])):
        sizes[source] += n
        order[source] += [doc_id] * n
    goals = targets(dict(sizes))
    for source, stream in order.items():
        for k in range(int(goals[source] + 1e-9)):
            taken[stream[k % len(stream)]] += 1
    return {s: (sizes[s], goals[s]) for s in sizes}, taken


def table(grid):
    """Rows of (text, columns, rows) as a browser's grid, drawn cell by cell."""
    owner, begins = {}, {}
    for y, row in enumerate(grid):
        x = 0
        for text, columns, rows in row:
            while (x, y) in owner:
                x += 1
            begins[x, y] = text
            for dy in range(rows):
                for dx in range(columns):
                    owner[x + dx, y + dy] = True
            x += columns
    columns = sorted({x for x, _ in begins})
    width = {x: max(len(t) for (a, _), t in begins.items() if a == x) for x in columns}
    lines = []
    for y in range(len(grid)):
        texts = [begins.get((x, y), "") for x in columns]
        if any(texts):
            while not texts[-1]:
                texts.pop()
            lines.append(" | ".join(t + " " * (width[x] - len(t)) for t, x in zip(texts, columns)).rstrip())
    return "\n".join(lines)


def listed(ordered, items):
    """Nested items (word, whether the inner list is numbered, inner items) as lines."""
    out = []
    for i, (word, inner_ordered, inner) in enumerate(items):
        mark = f"{i + 1}. " if ordered else "- "
        out += [mark + word, *(" " * len(mark) + line for line in (listed(inner_ordered, inner) if inner else []))]
    return out


FIXED = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": (r"AKIA[A-Z0-9]+", re.A),
    "hex": (r"[0-9a-f]+", re.A),
}


def base_secrets(text):
    found = []
    for rank, (kind, (pattern, flags)) in enumerate(FIXED.items()):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= {"access": 20, "hex": 24}[kind]:
                found.append((m.start(), rank, kind, m.end()))
    found.sort()
    return [(kind, start, end) for start, _, kind, end in found]


def base_digest(text):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_secrets(text)).encode()).hexdigest()


def all_secrets(text, ratios, alphabet, shortest, evidence, margin):
    """Base spans and the random ones, by a plain look at every candidate."""
    base = base_secrets(text)
    found = [(a, {"assign": 0, "access": 1, "hex": 2}[k], k, b) for k, a, b in base]
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{shortest},}}", text):
        score = sum(ratios[alphabet.index(x) * len(alphabet) + alphabet.index(y)] for x, y in zip(m[0], m[0][1:]))
        if score > max(evidence, margin * (len(m[0]) - 1)) and not any(a < m.end() and m.start() < b for _, a, b in base):
            found.append((m.start(), 3, "markov", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(found)]


def maximal_conversations(rows):
    """[(conv_id, turn, role, text)] to {conv_id: (n_turns, n_copies)}."""
    talks = defaultdict(set)
    for c, turn, role, text in rows:
        talks[c].add((turn is not None, turn or 0, role or "unknown", text or ""))
    talks = {c: tuple((r, x) for _, _, r, x in sorted(t)) for c, t in talks.items()}
    groups = defaultdict(list)
    for c, t in talks.items():
        groups[t].append(c)
    longer = {t[:k] for t in groups for k in range(1, len(t))}
    return {min(c, key=lambda x: (x is not None, x)): (len(t), len(c)) for t, c in groups.items() if t not in longer}


def robust_estimate(x, floors, covered, progress):
    """Rows of `x`, as numbers, that the smallest determinant over three starts and any number of steps covers."""
    def quantile(values, p):
        return np.sort(values)[max(0, int(np.ceil(p * len(values))) - 1)]

    def size(cov):
        return np.log(np.maximum(np.linalg.eigvalsh(cov / np.outer(floors, floors)), 1)).sum()

    def precision(cov):
        """Inverse after raising small eigenvalues, by adding what they lack along their directions."""
        unit = cov / np.outer(floors, floors)
        values, vectors = np.linalg.eigh(unit)
        for value, vector in zip(values, vectors.T):
            unit = unit + max(0, 1 - value) * np.outer(vector, vector)
        return np.linalg.inv(unit * np.outer(floors, floors))

    median = np.array([quantile(c, 0.5) for c in x.T])
    scale = np.maximum(1.4826 * np.array([quantile(c, 0.5) for c in np.abs(x - median).T]), floors)
    z = (x - median) / scale
    u = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    signs = (u.T @ u / len(x) + 0.01 * np.eye(x.shape[1])) * np.outer(scale, scale)
    best = (np.inf, None)
    for centre, inverse in ((median, np.diag(scale**-2.0)), (x.mean(axis=0), precision(np.cov(x.T, bias=True))), (median, np.linalg.inv(signs))):
        last, rows = np.inf, None
        while True:
            d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
            near = np.flatnonzero(d <= quantile(d, covered))
            cov = np.cov(x[near].T, bias=True).reshape(len(floors), -1)
            if not size(cov) < last - progress:
                break
            last, rows, centre, inverse = size(cov), near, x[near].mean(axis=0), precision(cov)
        if last < best[0]:
            best = (last, rows)
    return (*best, precision)


def robust_distances(vectors, groups, floors, covered, progress, shrink, correction):
    """Distances of the rows of `vectors` to the robust estimate of their group (lang, source)."""
    members = {g: np.array([i for i, x in enumerate(groups) if x == g]) for g in set(groups)}
    near, out = {}, np.zeros(len(vectors))
    for g, rows in members.items():
        _, chosen, precision = robust_estimate(vectors[rows], floors, covered, progress)
        near[g] = rows[chosen]
    for g, rows in members.items():
        wide = np.concatenate([r for h, r in near.items() if h[0] == g[0]])
        share = len(near[g]) / (len(near[g]) + shrink)
        cov = correction * (share * np.cov(vectors[near[g]].T, bias=True) + (1 - share) * np.cov(vectors[wide].T, bias=True))
        d = vectors[rows] - share * vectors[near[g]].mean(axis=0) - (1 - share) * vectors[wide].mean(axis=0)
        out[rows] = np.einsum("ij,jk,ik->i", d, precision(cov), d)
    return out


def quality_inputs(text):
    """The statistics of one text, counted plainly."""
    text = text or ""
    words, lines = WORDS.findall(text), text.split("\n")
    n, count = max(len(words), 1), lambda chars: sum(c in chars for c in text)
    upper = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    _, word_chars, symbols, dup_lines, repeats, _ = base_statistics(text)
    distinct, wide = len(set(words)), sum(ord(c) > 127 for c in text)
    shares = [symbols, upper, count("!\"'(),-./:;?[]`{}"), text.count("|"), count("0123456789"), wide]
    return [np.log1p(len(words)), np.log(max(word_chars, 1) / n), *(np.sqrt(x / n) for x in shares), np.sqrt(dup_lines / len(lines)), np.sqrt(repeats / n), np.log(max(distinct, 1) + 1) / np.log(n + 1), np.log(n / len(lines))]


def isotonic(y, weight):
    """Isotonic regression by the largest-of-smallest-means formula."""
    total, mass = np.r_[0, np.cumsum(y * weight)], np.r_[0, np.cumsum(weight)]
    n, best, out = len(y), -np.inf, []
    means = [[(total[b + 1] - total[a]) / (mass[b + 1] - mass[a]) if b >= a else np.inf for b in range(n)] for a in range(n)]
    for i in range(n):
        best = max(min(means[a][i:]) for a in range(i + 1))
        out.append(best)
    return np.array(out)


def quality_scores(rows, known, fold, model):
    """[(doc_id, text)], {doc_id: quality}, {doc_id: fold} and the module's parameters to {doc_id: score}."""
    import zlib

    z = np.array([quality_inputs(t) for _, t in rows])
    learn = [i for i, (d, _) in enumerate(rows) if d in known and zlib.crc32(str(d).encode()) % 3 != 1]
    y, f = np.array([float(known[rows[i][0]]) for i in learn]), np.array([fold[rows[i][0]] for i in learn])
    mean, scale = z[learn].mean(axis=0), np.maximum(z[learn].std(axis=0), 1e-3)
    z = (z - mean) / scale

    def solved(x, y, penalty):
        return np.linalg.solve(x.T @ x + penalty * len(x) * np.eye(x.shape[1]), x.T @ y)

    def features(bandwidth, reach, n):
        rng = np.random.default_rng(model.SEED)
        w, b = rng.normal(0, 1 / bandwidth, (z.shape[1], n)), rng.uniform(0, 2 * np.pi, n)
        return np.hstack([np.sqrt(2 / n) * np.cos(np.clip(z, -reach, reach) @ w + b), np.ones((len(z), 1))])

    def unseen(x, penalty):
        raw = np.zeros(len(y))
        for k in set(f):
            raw[f == k] = x[f == k] @ solved(x[f != k], y[f != k], penalty)
        return raw

    tried = []
    for bandwidth in model.BANDWIDTHS:
        for reach in model.REACHES:
            x = features(bandwidth, reach, model.SEARCH_FEATURES)[learn]
            tried += [(((unseen(x, p) - y) ** 2).sum(), bandwidth, reach, p) for p in model.RIDGES]
    _, bandwidth, reach, penalty = min(tried)
    x = features(bandwidth, reach, model.FEATURES)
    bins = np.rint(np.clip(unseen(x[learn], penalty), -1, 2) * model.BINS).astype(int)
    places = np.unique(bins)
    fitted = isotonic(np.array([y[bins == b].mean() for b in places]), np.array([(bins == b).sum() for b in places], dtype=float))
    first = np.r_[True, np.diff(fitted) > 1e-12]
    score = np.clip(np.interp(x @ solved(x[learn], y, penalty), places[first] / model.BINS, fitted[first]), 0, 1)
    return {d: float(s) for (d, _), s in zip(rows, score)}
