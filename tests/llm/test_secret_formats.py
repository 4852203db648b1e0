"""The network on findings of formats that its generator doesn't make, planted in texts of the smoke table."""

import random

from tessera.llm import secret_model, secret_scan
from tests.conftest import DATA
from tests.llm.test_llm import texts

MIXED = secret_model.MIXED


def value(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


SECRETS = [
    lambda r: f"stripe sk_live_{value(r, MIXED, 24)}", lambda r: f"AIza{value(r, MIXED + '-_', 35)}", lambda r: f"npm_{value(r, MIXED, 36)}", lambda r: f"AccountKey={value(r, MIXED + '+/', 86)}==",
    lambda r: f"glpat-{value(r, MIXED + '-_', 20)}", lambda r: f"SG.{value(r, MIXED, 22)}.{value(r, MIXED, 43)}", lambda r: f"Authorization: Bearer {value(r, secret_model.LETTERS, 32)}", lambda r: f"pwd: {value(r, MIXED, 11)}",
]
OTHERS = [
    lambda r: value(r, "123456789", 16), lambda r: "Nachbarschaftsvereinigungen", lambda r: "getElementByIdentifier", lambda r: f"https://example.org/wiki/{r.choice(['History', 'Geography'])}_of_Portugal", lambda r: "2024-03-0%dT10:22:3%d" % (r.randrange(1, 9), r.randrange(9)),
    lambda r: "state-of-the-art-performance", lambda r: "title: introduction", lambda r: "INTERNATIONALIZATION", lambda r: "src/main/resources/application.yaml", lambda r: "+49-30-5550-%04d" % r.randrange(9999),
]


def test_formats_that_the_generator_does_not_make(spark):
    rng = random.Random(3)
    hosts = [t for _, t in texts(spark.read.parquet(f"{DATA}/documents.parquet")) if 300 < len(t) < 4000][:100]
    rows, secret = [], {}
    for i in range(400):
        t, is_secret = rng.choice(hosts), i % 2 == 0
        at = t.index(" ", rng.randrange(len(t) // 2))
        planted = rng.choice(SECRETS if is_secret else OTHERS)(rng)
        rows.append((i, f"{t[:at]} {planted} {t[at:]}"))
        secret[i] = (at + 1, at + 1 + len(planted)) if is_secret else None
    hit, false = 0, 0
    for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("model")]
        planted = secret[r.doc_id]
        inside = [s for s in found if planted and planted[0] <= s[0] and s[1] <= planted[1]]
        hit += bool(inside)
        false += len(found) - len(inside)
    assert hit >= 0.9 * 200
    assert hit / (hit + false) >= 0.9


def test_every_part_of_a_long_run_is_scored(spark):
    rng = random.Random(4)
    key = value(rng, MIXED, 40)
    rows = [(1, "logs/" * 12 + key + "/logs" * 12), (2, "logs/" * 30)]
    got = {r.doc_id: r for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_model == 1 and got[2].n_model == 0
    for n in range(1, 300):
        covered = set()
        for a, b in secret_model.windows(n):
            assert 0 < b - a <= secret_model.INSIDE
            covered |= set(range(a, b))
        assert covered == set(range(n))


def test_base_spans_are_scored_too(spark):
    rows = [(1, f"token = {'0f3a9c71' * 5} and password: hunter2xyQ9"), (2, "token: required")]
    got = {r.doc_id: r for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_confirmed == 3 and got[2].n_confirmed == 0 and got[2].n_assign == 1
