"""The surrogate operator against a plain version: what is replaced, by what kind of thing, and one to one."""

import random

import pytest
import regex

from tessera.llm import pii
from tests.conftest import DATA

TITLED = regex.compile(f"^{pii.TITLE}")
#: Patterns of the test's own: what a person would call a name.
OWN_WORD = r"\p{Lu}(?:['’]?\p{Lu}?[\p{L}\p{M}])(?:[\p{L}\p{M}]|['’](?=\p{Lu}))*(?![\p{L}\p{N}])"
OWN_NAME = rf"(?<![\p{{L}}\p{{N}}-]){pii.TITLE}{OWN_WORD}(?:[ -]{OWN_WORD}){{0,2}}"


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_entities(text):
    """(start, end, type, normal form) of all that is to be replaced."""
    named = regex.search(OWN_NAME, text)
    numbers = "|".join((pii.EMAIL, pii.IP, pii.IBAN, pii.CARD, pii.SSN, pii.PHONE))
    bare = rf"(?<![\p{{L}}\p{{N}}]){OWN_WORD}(?![A-Za-z0-9._%+-]*@)"
    found = list(regex.finditer(f"{numbers}|{OWN_NAME}" + (f"|{bare}" if named else ""), text))
    genders = [(regex.split("[ -]", TITLED.sub("", m[0])), "m" if regex.match(rf"(?:{pii.MALE})\.? ", m[0]) else "f" if regex.match(rf"(?:{pii.FEMALE})\.? ", m[0]) else "n") for m in found if TITLED.match(m[0])]
    known = [(w.replace("’", "'").lower(), g) for words, g in genders for w in words]

    def same(w):
        w = w.replace("’", "'").lower()
        g = [g for x, g in known if x == w]
        return f"{next((x for x in g if x != 'n'), 'n')}:{w.lower()}" if g else None

    out = []
    for m in found:
        s, digits = m[0], regex.sub("[^0-9]", "", m[0])
        if title := TITLED.match(s):
            _, g = genders.pop(0)
            at = m.start() + title.end()
            for w in regex.split("[ -]", s[title.end() :]):
                out.append((at, at + len(w), "name", same(w) if g == "n" else f"{g}:{w.replace(chr(8217), chr(39)).lower()}"))
                at += len(w) + 1
        elif regex.fullmatch(OWN_WORD, s):
            if e := same(s):
                out.append((m.start(), m.end(), "name", e))
        elif "@" in s:
            out.append((m.start(), m.end(), "email", s.lower()))
        elif regex.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", s):
            out.append((m.start(), m.end(), "ip", s))
        elif regex.match("[A-Z]{2}[0-9]{2}", s):
            out.append((m.start(), m.end(), "iban", s.replace(" ", "")))
        elif regex.fullmatch("[0-9][0-9 -]*", s) and 13 <= len(digits) <= 19:
            if luhn(digits):
                out.append((m.start(), m.end(), "card", digits))
        else:
            out.append((m.start(), m.end(), "ssn" if regex.fullmatch(r"\d{3}-\d{2}-\d{4}", s) else "phone", digits))
    return out


FORMS = {"email": r"[^@\s]+@[a-z]{8}\.example\.net", "ip": r"(?:24\d|25[0-4])(?:\.\d{1,3}){3}", "name": r"\p{Lu}(?:\p{Ll}+|\p{Lu}+)"}


def check(pairs):
    """pairs: (text, rewritten text). Each entity has one surrogate, no two the same, none an entity of the corpus."""
    chosen, real = {}, set()
    for text, got in pairs:
        pattern, at, order = "", 0, plain_entities(text)
        for a, b, kind, normal in order:
            form = FORMS.get(kind) or "".join(r"[0-9]" if c.isdigit() else "[A-Z]" if kind == "iban" and c.isupper() else regex.escape(c) for c in text[a:b])
            pattern += regex.escape(text[at:a]) + f"({form})"
            at = b
            real.add((kind, normal))
        m = regex.fullmatch(pattern + regex.escape(text[at:]), got, regex.S)
        assert m, (text, got)
        for (a, b, kind, normal), s in zip(order, m.groups()):
            s = s.lower() if kind in ("email", "name") else s if kind == "ip" else regex.sub("[^0-9A-Z]", "", s)
            s = f"{normal[:2]}{s}" if kind == "name" else s
            assert chosen.setdefault((kind, normal), s) == s
            assert kind != "card" or luhn(s) and s[0] == normal[0]
            assert kind != "iban" or s[:2] == normal[:2]
            assert kind != "phone" or s[:-10] == normal[:-10]
    assert len({(kind, s) for (kind, _), s in chosen.items()}) == len(chosen)
    assert not real & {(kind, s) for (kind, _), s in chosen.items()}
    return chosen


MADE = [
    "Mrs Anna Smith called. Anna Smith said so; Smith, and Anna's friend. Young people smith.",
    "Dr. Jones met Mr. John Smith. Mr. Smith and Dr. John Smith left. Jones stayed with Prof Maria-Elena Lopez.",
    "2024-01-15 555-123-4567 and 100 555-123-4567, 555-123-4567 555-987-6543", "123-45-6789 987-65-4321 4539 5787 6362 1486 4539-5787-6362-1487 4 5 3 9 5 7 8 7 6 3 6 2 1 4 8 6",
    "Herr Müller schrieb an Müller@example.com, Frau Jäger-Weiß und Jäger. Anna.Smith@x.org", "г-жа Иванова и г-н Иванов. Иванова ушла. д-р Иванова", "κ Dr. Παπαδόπουλος και Παπαδόπουλος",
    "DE89 3704 0044 0532 0130 00, +1 (743) 555-3824, 10.0.0.1, a@b.example.com A@B.example.com", "Mrs May came in May. " + "word " * 3000 + "May again",
]


def test_made_texts(spark):
    rng = random.Random(2)
    texts = MADE + [" ".join(rng.choice(regex.split(r"(?<=\s)", " ".join(MADE[:8]))) for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame([(i if i % 20 != 19 else None, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "y")], "doc_id long, text string, ms string")
    out = pii.pseudonymize(df, "k")
    assert out.columns == ["doc_id", "text", "ms", "n_entities"]
    rows = out.collect()
    assert len(rows) == len(texts) + 1
    got = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    chosen = check([(t, got[i]) for i, t in enumerate(texts) if i % 20 != 19])
    assert {"f:anna", "f:smith", "m:smith", "n:jones"} <= {n for k, n in chosen if k == "name"}
    for i, t in enumerate(texts):
        if i % 20 != 19:
            for _, _, kind, normal in plain_entities(t):
                left = {n for _, _, k, n in plain_entities(got[i]) if k == kind}
                assert normal not in left


def test_smoke_table(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in df.collect()}
    check([(before[r.doc_id], r.text) for r in pii.pseudonymize(df, "k").collect()])


def test_many_names_of_one_word(spark):
    names = spark.range(2_000_000).selectExpr("'name' AS type", "concat('f:', translate(cast(id AS string), '0123456789', 'abcdefghij')) AS entity")
    out = pii.assign(names, "k")
    assert out.count() == 2_000_000 == out.select("surrogate").distinct().count()


def test_key_is_asked_for(spark):
    with pytest.raises(TypeError):
        pii.pseudonymize(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"))


def test_whole_names_go(spark):
    """Capitals inside, apostrophes, names in capitals; nothing of a name is left, also not in later mentions."""
    texts = ["Mr. McDonald came. McDonald left, said Mrs. DeVito; DeVito's car.", "Mr. O'Brien met Dr. MacArthur. O'Brien and MacArthur. O’Brien", "Mrs Anna Smith, later ANNA SMITH and Smith's dog. Mr. SMITH!", "Frau von Berg, Herr D'Angelo-McKay", "г-жа Иванова и ИВАНОВА"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.pseudonymize(df, "k").collect()}
    for i, lost in enumerate((["McDonald", "Donald", "DeVito", "Vito"], ["Brien", "Arthur"], ["Anna", "ANNA", "Smith", "SMITH"], ["Angelo", "Kay"], ["Иванова", "ИВАНОВА"])):
        assert not any(x in out[i] for x in lost), out[i]
    assert "'s car" in out[0] and "'s dog" in out[2] and out[2].split(" and ")[0].split("later ")[1].isupper()
    assert out[4].split(" и ")[1] == out[4].split(" и ")[0].removeprefix("г-жа ").upper()


def test_many_entities_in_a_text_take_linear_time(spark):
    import time

    times = []
    for n in (2_000, 20_000):
        text = "Mr. Smith wrote: " + " ".join(f"user{i}@mail.org Smith Other{chr(97 + i % 26)}x" for i in range(n))
        start = time.perf_counter()
        got = pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
        times.append(time.perf_counter() - start)
        assert got.n_entities == 2 * n + 1 and "Smith" not in got.text
    assert times[1] < 10 * times[0] + 10
