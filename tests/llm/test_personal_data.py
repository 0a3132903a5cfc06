"""Surrogates against a plain Python form of the same rules, mention by mention."""

import hashlib

import regex
from pyspark.sql import functions as F

from snapsync.llm import pii, queries
from snapsync.llm.common import table
from tests.conftest import SF

OWN, (EVERY, _) = pii.patterns(pii.GIVEN), pii.searches(pii.GIVEN)
LISTED = {n for names in pii.GIVEN.values() for n in names}


def number(digest, i, n):
    return (int(digest[i * 4 % 120 : i * 4 % 120 + 4], 16) + i * 7) % n


def like(c, digest, i):
    if c in "0123456789":
        return str(number(digest, i, 10))
    for script, pattern in (("cyrillic", r"\p{Cyrillic}"), ("greek", r"\p{Greek}"), ("latin", r"\p{L}")):
        if regex.match(pattern, c):
            vowels, consonants = pii.SCRIPTS[script]
            letters = vowels if c in vowels + pii.MORE_VOWELS else consonants
            return letters[number(digest, i, len(letters))]
    return c


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10


def kind_of(m):
    if "@" in m:
        return "email"
    return next((k for k in ("ipv6", "ip", "number", "phone", "iban") if regex.fullmatch(OWN[k], m)), "card" if m[0].isdigit() else "name")


def entity_of(kind, m):
    if kind in ("email", "ip", "ipv6"):
        return m.lower()
    return m.lower().replace(" ", "") if kind == "iban" else m.split(" ")[-1].lower() if kind == "name" else regex.sub("[^0-9]", "", m)


def draw(key, kind, e, n):
    d = hashlib.sha512(f"{key}|{kind}|{e}|{n}".encode()).hexdigest()
    more = d.translate(str.maketrans("0123456789", "ghijklmnop"))[: n - pii.LONGER + 1] if n >= pii.LONGER else ""
    if kind == "email":
        host = len(e) - len(e.split(".")[-1])
        return more + "".join(like(c, d, i) if i < host else c for i, c in enumerate(e))
    if kind == "ip":
        return f"{number(d, 0, 112) + 11}.{number(d, 5, 256)}.{number(d, 9, 256)}.{number(d, 13, 254) + 1}"
    if kind == "ipv6":
        return "".join(c if c == ":" else f"{number(d, i, 16):x}" for i, c in enumerate(e))
    if kind == "iban":
        rest = "".join(str(number(d, i, 10)) if c.isdigit() else chr(97 + number(d, i, 26)) for i, c in enumerate(e[4:]))
        return f"{e[:2]}{98 - int(''.join(str(int(c, 36)) for c in rest + e[:2] + '00')) % 97:02}{rest}"
    if kind == "name":
        return "".join(like(c, d, i) for i, c in enumerate(e)) + more
    digits = "".join(c if i == 0 else str(number(d, i, 10)) for i, c in enumerate(e))
    return next(x for x in (digits[:-1] + str(k) for k in range(10)) if luhn(x) == 0) if kind == "card" and luhn(e) == 0 else digits


def cased(new, old):
    return "".join(c.upper() if old[min(i, len(old) - 1)].isupper() else c for i, c in enumerate(new))


def unlisted(kind, m):
    words = m.split(" ")[:-1] if kind == "name" else []
    return next((w.lower() for w in words if not regex.fullmatch(rf"(?:{'|'.join(pii.TITLES)})\.?|\p{{Lu}}\.", w) and w not in pii.PARTICLES and w.lower().title() not in LISTED), None)


def initial(w, e, key):
    d = hashlib.sha256(f"{key}|initial|{e}".encode()).hexdigest()
    for vowels, consonants in pii.SCRIPTS.values():
        letters = "".join(sorted(vowels + consonants))
        if w[0].lower() in letters:
            return letters[(letters.index(w[0].lower()) + 1 + number(d, 0, len(letters) - 1)) % len(letters)].upper() + "."
    return w


def renamed(m, e, new, other, key):
    out, words = [], m.split(" ")
    for i, w in enumerate(words):
        names = next((x for x in pii.GIVEN.values() if w.lower().title() in x), None)
        if i == len(words) - 1:
            w = cased(new, w)
        elif regex.fullmatch(rf"(?:{'|'.join(pii.TITLES)})\.?", w) or w in pii.PARTICLES:
            pass
        elif regex.fullmatch(r"\p{Lu}\.", w):
            w = initial(w, e, key)
        elif names:
            order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{e}|{n}".encode()).hexdigest())
            n = order[(order.index(w.lower().title()) + 1) % len(order)]
            w = n.upper() if w.isupper() else n
        else:
            w = cased(other, w)
        out.append(w)
    return " ".join(out)


def brute_force(texts, key):
    mentions = []
    for t in texts:
        found = [m[0] for m in regex.finditer(EVERY, t)]
        last = [m.split(" ")[-1] for m in found if regex.fullmatch(OWN["name"], m)]
        forms = {x for w in last if len(w) >= pii.LEAST_BARE for x in (w, w.upper(), w.lower().capitalize())}
        search = EVERY + (rf"|(?<!\p{{L}})(?:{'|'.join(map(regex.escape, forms))})(?!\p{{L}})" if forms else "")
        mentions.append([(m.start(), m.end(), m[0]) for m in regex.finditer(search, t)])
    kept = lambda m: m[:19] if regex.match(r"(?:\d{4}[ -]){4}", m) and not (luhn(regex.sub(r"\D", "", m[:19])) and not luhn(regex.sub(r"\D", "", m))) else m
    mentions = [[(a, kind_of(m), kept(m) if kind_of(m) == "card" else m) for a, _, m in found] for found in mentions]
    pairs = {(k, entity_of(k, m)) for found in mentions for _, k, m in found} | {(k, unlisted(k, m)) for found in mentions for _, k, m in found if unlisted(k, m)}
    taken, todo, new = set(pairs), sorted(pairs), {}
    for n in range(pii.DRAWS):
        drawn, left = {}, []
        for k, e in todo:
            s = (k, draw(key, k, e, n))
            drawn.setdefault(s, []).append((k, e))
        for s, owners in drawn.items():
            first = min(owners)
            if s in taken:
                left += owners
            else:
                new[first] = s[1]
                left += [o for o in owners if o != first]
        taken |= {(k, new[k, e]) for k, e in todo if (k, e) in new}
        todo = sorted(left)
    out = []
    for t, found in zip(texts, mentions):
        at, parts = 0, []
        for a, k, m in found:
            e = entity_of(k, m)
            digits = iter(new[k, e])
            s = {
                "email": lambda: cased(new[k, e], m), "ipv6": lambda: cased(new[k, e], m), "ip": lambda: new[k, e], "name": lambda: renamed(m, e, new[k, e], new.get((k, unlisted(k, m))), key),
                "iban": lambda: "".join(c if c == " " else next(digits).upper() for c in m),
            }.get(k, lambda: "".join(next(digits) if c.isdigit() else c for c in m))()
            parts += [t[at:a], s]
            at = a + len(m)
        out.append("".join(parts) + t[at:])
    return out


NAMES = [
    "Dr. Anna Schmidt met Anna McDonald and Anna O'Brien; ANNA SCHMIDT, Priya Patel, Wei Zhang; later Schmidt alone, and SCHMIDT.",
    "2001:db8::1 and fe80:0:0:0:202:b3ff:fe1e:8329 or ::1, not std::vector at 12:30:45",
    "Anna Müller-Weiß's house; Müller-Weiß. DE89 3704 0044 0532 0130 00 = DE89370400440532013000 GB82WEST12345698765432",
    "Frau Schmidt und Herr Max von der Berg, Anna M. Schmidt, Maria Schmidt, Иван Петров, ИВАН ПЕТРОВ, Prof. Dr. Peter van Dyke, Anna-Maria Li",
    "die.55@mail4.example.com Die.55@Mail4.example.com, 97.51.17.173, 9807915762804490, +1 (017) 555-7713, 123-45-6789 Anna Li a@y.io b@y.io c@y.io",
    "4111111111111111 123 4111 1111 1111 1111 123. 4111-1111-1111-1111-124 3782 822463 10005 1234 2024-10-12 2024-10-13",
]


def test_surrogates_equal_brute_force(spark):
    texts = NAMES + [f"Anna L{a}{b} {a}{b}@q.io" for a in "aeiou" for b in "nmr"] + [r.text for r in table(spark, SF, "documents").collect() if r.text]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.replace_personal(df, "k").orderBy("doc_id").collect()]
    want = brute_force(texts, "k")
    assert got == want
    assert sum(a != b for a, b in zip(got, texts)) > 25
    for word in ("Schmidt", "SCHMIDT", "McDonald", "O'Brien", "Patel", "Zhang", "Müller", "Weiß", "Петров", "2001:db8", "fe80", "3704"):
        assert not any(word in t for t in got[: len(NAMES)]), word
    assert "std::vector at 12:30:45" in got[1]
    iban = got[2].split(". ")[1][:27].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and f"= {iban} " in got[2]


def test_clashing_names_and_odd_rows(spark):
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "10.0.0.1"), (1, "10.0.0.1"), (None, "10.0.0.1"), (2, "x" * 100_000 + " a@b.cd")], "doc_id long, text string")
    clash = odd.withColumns({c: F.lit("mine") for c in ("__id", "__key", "__new", "row_number", "mentions", "bare", "news", "kind", "at", "Row", "__row_number", "OF_ROW")})
    out = pii.replace_personal(clash, "k")
    assert out.columns == clash.columns and out.where("mentions = 'mine' AND row_number = 'mine'").count() == 6
    texts = [r.text for r in out.collect()]
    assert texts.count(None) == 1 and "10.0.0.1" not in texts and len({t for t in texts if t and t[0].isdigit()}) == 1
    assert queries.op2_pii_surrogates(spark, SF).count() == table(spark, SF, "documents").count()
