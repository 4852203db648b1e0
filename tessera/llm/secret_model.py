"""A small character convolutional network in numpy that tells secrets from other strings.

The labelled findings it learns from are generated from a seed: secrets of the usual formats in the places where they
stand (after key names, in headers, in assignments, alone in prose), and look-alikes (addresses, paths, names, long words, versions,
dates, identifiers, numbers, markup). The generator is bounded by `findings`; a fit takes some seconds and is the same each
time. Fitting, calibration and threshold use three disjoint sets, the reported figures a fourth. The threshold is the
highest one that keeps the wanted recall on its set, whatever its value.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

BEFORE, INSIDE, AFTER = 24, 48, 8
LENGTH = BEFORE + INSIDE + AFTER
SYMBOLS, WIDTH, DIM, FILTERS = 256, 5, 8, 24

_CODES = np.full(128, 1, np.uint8)
_CODES[32:127] = np.arange(2, 97)


def codes(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    return np.where(a < 128, _CODES[np.minimum(a, 127)], 97).astype(np.uint8)


def windows(size: int) -> list[tuple[int, int]]:
    """Parts of a candidate that fit the network; they overlap by half, and all of a long candidate is in one of them."""
    if size <= INSIDE:
        return [(0, size)]
    return [(a, a + INSIDE) for a in range(0, size - INSIDE, INSIDE // 2)] + [(size - INSIDE, size)]


def encode(findings: list[tuple[str, str, str]]) -> np.ndarray:
    """(before, candidate, after) as symbols; a candidate's own characters, INSIDE at most, are marked."""
    out = np.zeros((len(findings), LENGTH), np.uint8)
    for row, (before, inside, after) in zip(out, findings, strict=True):
        b, i, a = codes(before[-BEFORE:]), codes(inside) + 128, codes(after[:AFTER])
        row[BEFORE - len(b) : BEFORE], row[BEFORE : BEFORE + len(i)], row[BEFORE + len(i) : BEFORE + len(i) + len(a)] = b, i, a
    return out


def _word(rng, low=2, high=4) -> str:
    """Syllables of common or of random letters: languages differ, and so must the words."""
    if rng.random() < 0.4:
        parts = rng.choice(["th", "an", "er", "in", "on", "re", "ti", "le", "que", "sch", "en", "os", "la", "mi", "ver", "ka", "to", "bu", "ing", "est", "ly", "ung", "eau", "ent"], high)
    else:
        head = rng.choice(["b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z", "ch", "st", "th", "sh", "tr", "pl", "str", "qu"], high)
        parts = [h + v + t for h, v, t in zip(head, rng.choice(["a", "e", "i", "o", "u", "y", "ea", "ou", "ie"], high), rng.choice(["", "", "", "n", "r", "s", "t", "l", "nd", "st", "ng", "tz"], high), strict=True)]
    return "".join(parts[: rng.integers(low, high + 1)])


def _prose(rng) -> str:
    words = [_word(rng, 1, 4) for _ in range(rng.integers(2, 7))]
    style = rng.random()
    words = [w.upper() if style < 0.08 else w.title() if rng.random() < 0.15 else w for w in words]
    return rng.choice([" ", " ", " ", ", ", "\n", " | ", ". ", "! ", "* "]).join(words) + rng.choice(["", "", ",", ".", "\n", "é", " -"])


def _random(rng, alphabet: str, n: int) -> str:
    return "".join(rng.choice(list(alphabet), n))


LETTERS = "abcdefghijklmnopqrstuvwxyz"
MIXED = LETTERS + LETTERS.upper() + "0123456789"


DIGITS, HEX = "0123456789", "0123456789abcdef"
LEADS = ["password: ", "passwd=", 'token = "', "api_key=", "secret: ", "Authorization: Bearer ", "bearer ", "client_key=", "aws_key: ", 'auth = "', "credential ", "private_key=", "-H 'X-Auth: ", "pwd ", "pwd: ", "pass = ", "AccountKey=", "SharedKey=", "sig=", "Basic ", "key: "]


def _secret(rng) -> tuple[str, str, str]:
    n, short = int(rng.integers(20, 64)), int(rng.integers(8, 20))
    values = [
        lambda: _random(rng, MIXED, n),
        lambda: base64.b64encode(rng.bytes(n)).decode().rstrip("="),
        lambda: "gh" + rng.choice(["p", "o", "s"]) + "_" + _random(rng, MIXED, 36),
        lambda: "sk-" + _random(rng, MIXED, 40),
        lambda: "eyJ" + _random(rng, MIXED, 20) + ".eyJ" + _random(rng, MIXED, 40) + "." + _random(rng, MIXED, 30),
        lambda: "xox" + rng.choice(["b", "p"]) + "-" + _random(rng, DIGITS, 11) + "-" + _random(rng, MIXED, 24),
        lambda: _random(rng, HEX.upper(), int(rng.choice([32, 40, 64]))),
        lambda: _random(rng, LETTERS + LETTERS.upper(), n),
        lambda: _random(rng, HEX, int(rng.choice([24, 32, 40, 64]))),
        lambda: "AKIA" + _random(rng, LETTERS.upper() + DIGITS, 16),
    ]
    weak = [lambda: _random(rng, MIXED, short), lambda: _random(rng, LETTERS, short), lambda: _word(rng, 2, 3) + _random(rng, MIXED, 4) + str(rng.integers(10, 999))]
    if rng.random() < 0.35:  # these are secrets only by what stands before them
        value, lead = weak[rng.integers(len(weak))](), rng.choice(LEADS)
    else:
        value, lead = values[rng.integers(len(values))](), rng.choice(["", "", "", *LEADS])
    close = {'"': '"', "'": "'"}.get(lead.strip()[-1:], rng.choice([" ", "\n", ";", ", "]))
    return _prose(rng) + " " + lead, value, close + _prose(rng)


def _other(rng) -> tuple[str, str, str]:
    digits = lambda n: _random(rng, DIGITS, n)
    values = [
        lambda: _word(rng) + "." + digits(2) + "." + _word(rng) + ".example.com",
        lambda: "/".join(_word(rng) for _ in range(rng.integers(3, 8))) + str(rng.integers(9)),
        lambda: "-".join(_word(rng) for _ in range(rng.integers(2, 6))),
        lambda: "-".join(_word(rng) for _ in range(rng.integers(3, 6))) + "-" + str(rng.integers(2000, 2030)),
        lambda: _word(rng, 6, 12) + str(rng.integers(100)),
        lambda: _word(rng, 5, 16),
        lambda: _word(rng, 4, 8),
        lambda: _word(rng, 5, 9).title(),
        lambda: _word(rng, 4, 9).upper(),
        lambda: _word(rng, 2, 5) + "." + _word(rng, 2, 5).title(),
        lambda: digits(16),
        lambda: rng.choice(list("3456")) + digits(15),
        lambda: rng.choice(["Bearer", "Basic", "required", "string", "default", "password"]),
        lambda: _word(rng) + "_" + _word(rng) + "_" + _word(rng) + "_v" + str(rng.integers(9)) + ".py",
        lambda: f"{rng.integers(2000, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}.{rng.integers(10, 60)}.{rng.integers(10, 60)}.{digits(3)}Z",
        lambda: "mail" + str(rng.integers(9)) + ".example.com",
        lambda: "-" * int(rng.integers(8, 60)),
        lambda: _word(rng).title() + _word(rng).title() + _word(rng).title() + _word(rng).title() + str(rng.integers(99)),
        lambda: _word(rng) + _word(rng).title() + _word(rng).title(),
        lambda: digits(int(rng.integers(8, 20))),
        lambda: digits(3) + "-" + digits(3) + "-" + digits(4),
        lambda: ".".join(str(rng.integers(256)) for _ in range(4)),
        lambda: _word(rng, 1, 2) + "." + _word(rng, 2, 4).title(),
        lambda: "-".join(_random(rng, HEX, k) for k in (8, 4, 4, 4, 12)),
        lambda: f"v{rng.integers(20)}.{rng.integers(99)}.{rng.integers(99)}-{_word(rng, 1, 2)}.{rng.integers(9)}",
    ]
    if rng.random() < 0.03:  # the scheme before a secret isn't one
        return _prose(rng) + " Authorization: ", rng.choice(["Bearer", "Basic", "Digest"]), " " + _random(rng, MIXED, 24)
    value = values[rng.integers(len(values))]()
    lead = rng.choice(["", "", "", "see ", "https:/", _word(rng) + "@", "(", "file ", "name: ", "title = ", _word(rng) + ": ", _word(rng) + "=", 'lang = "', "key ", "basic ", "Authorization: ", digits(14) + " ", "card "])
    return _prose(rng) + " " + lead, value, rng.choice([" ", ".", ") ", ", ", "\n"]) + _prose(rng)


def labelled(findings: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 2, findings)
    rows = []
    for y in labels:
        before, value, after = (_secret if y else _other)(rng)
        a, b = (spots := windows(len(value)))[rng.integers(len(spots))]
        rows.append((before + value[:a], value[a:b], value[b:] + after))
    return encode(rows), labels.astype(np.float32)


def forward(model: dict, x: np.ndarray):
    e = model["embed"][x]
    cols = np.concatenate([e[:, k : LENGTH - WIDTH + 1 + k] for k in range(WIDTH)], axis=2)
    z = cols @ model["conv"] + model["bias"]
    h = np.maximum(z, 0)
    pooled = np.concatenate([h.max(1), h.mean(1)], axis=1)
    return cols, z, h, pooled, pooled @ model["out"] + model["out_bias"]


def probability(model: dict, texts: list[str], spans: list[tuple[int, int, int]], batch: int = 256) -> np.ndarray:
    """Calibrated probability that each span (text, start, end) is a secret: the greatest of its windows'."""
    if not spans:
        return np.zeros(0)
    parts = [(i, a + x, a + y) for i, a, b in spans for x, y in windows(b - a)]
    first = np.cumsum([0, *(len(windows(b - a)) for _, a, b in spans[:-1])])
    logits = []
    for k in range(0, len(parts), batch):
        x = encode([(texts[i][max(0, a - BEFORE) : a], texts[i][a:b], texts[i][b : b + AFTER]) for i, a, b in parts[k : k + batch]])
        logits.append(forward(model, x)[-1])
    return 1 / (1 + np.exp(-(model["slope"] * np.maximum.reduceat(np.concatenate(logits), first) + model["shift"])))


@lru_cache(4)
def _trained(findings: int, seed: int, epochs: int, recall: float) -> str:
    rng = np.random.default_rng(seed)
    x, y = labelled(findings, seed)
    model = {"embed": rng.normal(0, 0.3, (SYMBOLS, DIM)), "conv": rng.normal(0, 0.2, (WIDTH * DIM, FILTERS)), "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.2, 2 * FILTERS), "out_bias": np.zeros(1)}
    model = {k: v.astype(np.float32) for k, v in model.items()}
    m, v, step, steps = {k: 0 * w for k, w in model.items()}, {k: 0 * w for k, w in model.items()}, 0, LENGTH - WIDTH + 1
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            xb, yb = x[order[i : i + 128]], y[order[i : i + 128]]
            cols, z, h, pooled, logit = forward(model, xb)
            d = (1 / (1 + np.exp(-logit)) - yb) / len(yb)
            dp = d[:, None] * model["out"]
            dh = np.broadcast_to(dp[:, None, FILTERS:] / steps, h.shape).copy()
            np.put_along_axis(dh, h.argmax(1)[:, None], np.take_along_axis(dh, h.argmax(1)[:, None], 1) + dp[:, None, :FILTERS], 1)
            dz = dh * (z > 0)
            dcols = dz @ model["conv"].T
            de = np.zeros((*xb.shape, DIM), np.float32)
            for k in range(WIDTH):
                de[:, k : k + steps] += dcols[:, :, k * DIM : (k + 1) * DIM]
            flat = xb.ravel()
            grads = {"embed": np.stack([np.bincount(flat, de[..., j].ravel(), SYMBOLS) for j in range(DIM)], 1), "conv": np.tensordot(cols, dz, ((0, 1), (0, 1))), "bias": dz.sum((0, 1)), "out": pooled.T @ d, "out_bias": d.sum(keepdims=True)}
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model[k] = (model[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    held, truth = labelled(findings // 2, seed + 1)
    logit = forward(model, held)[-1].astype(np.float64)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Platt's scaling by Newton steps
        p = 1 / (1 + np.exp(-(slope * logit + shift)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - truth) * logit).sum(), (p - truth).sum()])
        hess = np.array([[(w * logit * logit).sum() + 1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(hess, g)

    def scored(k: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = labelled(findings // 2, seed + k)
        return 1 / (1 + np.exp(-(slope * forward(model, x)[-1] + shift))), y

    p, truth = scored(2)
    found = np.sort(p[truth == 1])
    threshold = found[int((1 - recall) * len(found))]  # the highest that keeps this recall
    p, truth = scored(3)
    hit = p >= threshold
    return json.dumps({k: w.tolist() for k, w in model.items()} | {"slope": slope, "shift": shift, "threshold": float(threshold), "recall": float(hit[truth == 1].mean()), "precision": float(truth[hit].mean())})


def trained(findings: int = 5000, seed: int = 7, epochs: int = 6, recall: float = 0.99) -> dict:
    """The fitted network with its threshold: the highest one whose recall on a set of its own is at least `recall`."""
    model = json.loads(_trained(findings, seed, epochs, recall))
    return {k: np.array(w, np.float32) if isinstance(w, list) else w for k, w in model.items()}
