"""Surrogates for personal data: e-mail and IP addresses, bank accounts, cards, phone and identity numbers, names.

A mention is reduced to its entity (letters in lower case, or the digits alone; of a name, its last word). A keyed hash
of the entity makes a surrogate of the same type: vowels for vowels and consonants for consonants of the same script,
digits for digits, valid check digits. The surrogates of all entities are held against each other and against all
entities found; of those that collide all but the first draw again. So two entities never share a surrogate, no
surrogate is someone else's datum, and all mentions of an entity, in whatever case or with whatever separators, get the
same surrogate, written in the mention's own format.

Names are found by a title of TITLES or a given name of `given` (lists by gender and script) in front: words with a
capital, all capitals, apostrophes, inner capitals, hyphens and particles. A surname found so is also replaced where it
stands alone in the same text. For each surname, a keyed order of each list says which given name another becomes:
persons of one surname stay apart, and one known pair tells nothing about the next. Persons without a title or a listed
given name keep their names; `given` takes longer lists.

Cards are groups of 4-4-4-4, 4-4-4-4-3, 4-6-5 or 4-6-4 digits with one kind of separator, or 13 to 19 digits without
any. Three digits after 4-4-4-4 belong to the card only if the check digit is right with them and wrong without. Bank
accounts keep their country. The short and the full form of an IPv6 address are two entities.

Texts are searched once: a copy of docs with the mentions of each text is written to the shared folder, and only rows
with mentions go on from there.

Results for odd input: null and empty texts stay as they are; rows are treated one by one, whatever their ids; columns
named like those that are added inside stay untouched; all columns are kept, n_chars (where there is one) is counted
anew for rows that changed. If the surrogates of one form run out (after DRAWS rounds) an error says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapsync.llm.common import free_names, written

#: Given names by gender and script; each becomes another of its own list.
GIVEN = {
    "female latin": "Anna Maria Emma Julia Laura Sophie Claire Isabel Carmen Elena Sarah Emily Katharina Camille Alice Helen Ursula Brigitte Monique Dolores Priya Fatima Aisha Mei Yuki Ingrid Nadia Leila Sofia Olivia Hannah Ananya".split(),
    "male latin": "James John Robert Michael William Thomas Peter Hans Klaus Pierre Jean Carlos Miguel Juan David Paul Stefan Wolfgang Antoine Javier Wei Ahmed Mohammed Raj Hiroshi Lars Omar Ivan Daniel Andrew Arjun Kenji".split(),
    "female cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    "male cyrillic": "Иван Александр Сергей Дмитрий Андрей Алексей Николай Михаил".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Monsieur Madame Señor Señora".split()
PARTICLES = "van von de del della der den di da dos du la le bin al".split()
#: Vowels and consonants of each script that surrogates are made of, and the other letters that count as vowels.
SCRIPTS = {"latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"), "cyrillic": ("аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"), "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ")}
MORE_VOWELS = "àáâãäåæèéêëìíîïòóôõöøùúûüœёάέήίόύώ"

_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+"
_SURNAME = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_WORD}(?:-{_WORD})*+"
_TITLE = rf"(?:{'|'.join(TITLES)})\.? "


def _any_of(words: list[str]) -> str:
    """An alternation of words, by first letter."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (w[0], -len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by.items()) + ")"


def patterns(given: dict[str, list[str]]) -> dict[str, str]:
    listed = _any_of(sorted({x for names in given.values() for n in names for x in (n, n.upper())}))
    return {
        "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
        "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
        "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4}(?![0-9])",
        "number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "card": r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4} (?:(?:[0-9]{4} ){2}[0-9]{4}(?: [0-9]{3}(?![0-9]))?|[0-9]{6} [0-9]{4,5})(?![0-9])|(?<![0-9])(?<![0-9]-)[0-9]{4}-(?:(?:[0-9]{4}-){2}[0-9]{4}(?:-[0-9]{3}(?![0-9]))?|[0-9]{6}-[0-9]{4,5})(?!-?[0-9])",
        "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
        "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
        "name": rf"(?<!\p{{L}})(?:(?:{_TITLE}){{0,2}}(?:{listed}-{listed} |(?:{listed} ){{1,3}})|(?:{_TITLE}){{1,2}}(?:{_WORD}(?:-{_WORD})* )?)(?:\p{{Lu}}\. )?{_SURNAME}(?!\p{{L}})",
    }


def searches(given: dict[str, list[str]]) -> tuple[str, str]:
    """One search for all types, the first that fits at a place; and one for texts without the signs of RARE."""
    own = patterns(given)
    either = lambda kinds: "|".join(f"(?:{own[k]})" for k in kinds)
    # Most characters are small letters, where nothing but an address can begin: one look tells.
    plain = rf"(?=[0-9+(\p{{Lu}}])(?:{either(('phone', 'number', 'card', 'ip', 'iban', 'name'))})"
    return f"{either(('email', 'ipv6'))}|{plain}", plain


#: Without one of these a text holds no e-mail and no IPv6 address.
RARE = "@|[0-9A-Fa-f:]:[0-9A-Fa-f:]"
#: Letters from which a surname is looked for by itself.
LEAST_BARE = 3
#: Draws before the rounds give up; from `LONGER` on, letters are added, so that short names can't run out.
DRAWS, LONGER = 40, 3


def _kind(mention: Column, own: dict[str, str]) -> Column:
    full = lambda k: mention.rlike(f"^(?:{own[k]})$")
    kind = F.when(mention.contains("@"), "email")
    for k in ("ipv6", "ip", "number", "phone", "iban"):
        kind = kind.when(full(k), k)
    return kind.when(mention.rlike("^[0-9]"), "card").otherwise("name")


def _last_word(mention: Column) -> Column:
    return F.element_at(F.split(mention, " "), -1)


def _entity(kind: Column, mention: Column) -> Column:
    lower = F.lower(mention)
    return F.when(kind.isin("email", "ip", "ipv6"), lower).when(kind == "iban", F.replace(lower, F.lit(" "), F.lit(""))).when(kind == "name", F.lower(_last_word(mention))).otherwise(F.regexp_replace(mention, "[^0-9]", ""))


def _characters(text: Column, use) -> Column:
    """text with each character and its place (from 0) given to use."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), use), "")


def _number(digest: Column, i: Column, n: int) -> Column:
    """A number below n from the i-th of a digest's hexadecimal digits."""
    return (F.conv(F.substring(digest, (i * 4) % 120 + 1, 4), 16, 10).cast("int") + i.cast("int") * 7) % n


def _luhn(digits: Column) -> Column:
    """Sum of a digit string by the rule of card numbers; valid if a multiple of ten."""
    value = lambda i: F.substring(F.reverse(digits), i, 1).cast("int")
    weigh = lambda i: F.when(i % 2 == 1, value(i)).otherwise(F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + weigh(i))


def _mod_97(text: Column) -> Column:
    """Remainder of an account's characters (small letters count from 10) as one number."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), s * 10 + c.cast("int")).otherwise(s * 100 + F.ascii(c) - 87) % 97
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _after_card(kind: Column, mention: Column) -> Column:
    """What follows a card in its mention and isn't part of it."""
    valid = lambda text: _luhn(F.regexp_replace(text, "[^0-9]", "")) % 10 == 0
    longer = (kind == "card") & mention.rlike("^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -]")
    short = F.substring(mention, 1, 19)
    return F.when(longer, F.when(~valid(short) & valid(mention), "").otherwise(F.substring(mention, 20, 4))).otherwise("")


def _like(c: Column, digest: Column, i: Column) -> Column:
    """A drawn character of the kind of c: a digit, a vowel or a consonant of its script, or c itself."""
    of = lambda letters: F.substring(F.lit(letters), _number(digest, i, len(letters)) + 1, F.lit(1))
    out = F.when(c.rlike("[0-9]"), _number(digest, i, 10).cast("string"))
    for script in ("cyrillic", "greek", "latin"):
        vowels, consonants = SCRIPTS[script]
        own = c.rlike({"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "latin": r"\p{L}"}[script])
        out = out.when(own & c.rlike(f"[{vowels}{MORE_VOWELS}]"), of(vowels)).when(own, of(consonants))
    return out.otherwise(c)


def surrogate(key: str, kind: Column, entity: Column, draw: Column) -> Column:
    """The draw-th surrogate of an entity, in the entity's own normal form."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, entity, draw.cast("string")), 512)
    more = F.when(draw >= LONGER, F.substring(F.translate(digest, "0123456789", "ghijklmnop"), 1, draw - LONGER + 1)).otherwise("")
    host = F.length(entity) - F.length(F.substring_index(entity, ".", -1))
    email = F.concat(more, _characters(entity, lambda c, i: F.when(i < host, _like(c, digest, i)).otherwise(c)))
    octet = lambda i, low, n: (_number(digest, F.lit(i), n) + low).cast("string")
    ip = F.concat_ws(".", octet(0, 11, 112), octet(5, 0, 256), octet(9, 0, 256), octet(13, 1, 254))
    ipv6 = _characters(entity, lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(_number(digest, i, 16)))))
    account = _characters(F.substring(entity, F.lit(5), F.length(entity)), lambda c, i: F.when(c.rlike("[0-9]"), _number(digest, i, 10).cast("string")).otherwise(F.char(_number(digest, i, 26) + 97)))
    country = F.substring(entity, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    digits = _characters(entity, lambda c, i: F.when(i == 0, c).otherwise(_number(digest, i, 10).cast("string")))
    shorter = F.substring(digits, F.lit(1), F.length(digits) - 1)
    checked = F.concat(shorter, ((10 - _luhn(F.concat(shorter, F.lit("0"))) % 10) % 10).cast("string"))
    card = F.when(_luhn(entity) % 10 == 0, checked).otherwise(digits)
    name = F.concat(_characters(entity, lambda c, i: _like(c, digest, i)), more)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "iban", iban).when(kind == "card", card).when(kind == "name", name).otherwise(digits)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity, surrogate: distinct surrogates for the distinct rows (kind, entity)."""
    # A drawing costs far more than its row's bytes tell: rows are dealt out by number, which sizes don't undo.
    parallel = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo, parts = entities.repartition(parallel).withColumn("draw", F.lit(0)), []
    for _ in range(DRAWS):
        drawn = todo.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("entity"), F.col("draw")))
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("entity")) == 1
        drawn = drawn.withColumn("free", first)
        for held in [entities.select("kind", F.col("entity").alias("surrogate")), *(p.select("kind", "surrogate") for p in parts)]:
            drawn = drawn.join(held.withColumn("held", F.lit(True)), ["kind", "surrogate"], "left").withColumn("free", F.col("free") & F.col("held").isNull()).drop("held")
        drawn = written(drawn)
        parts.append(drawn.where("free"))
        todo = drawn.where("NOT free").select("kind", "entity", (F.col("draw") + 1).alias("draw"))
        if todo.isEmpty():
            break
    else:
        raise RuntimeError("personal data of one form outnumber the surrogates of that form")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("kind", "entity", "surrogate")


def _cased(new: Column, old: Column) -> Column:
    """new with capitals where old has them; what is longer than old follows its last letter."""
    upper = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    place = lambda i: F.least(i + 1, F.length(old))
    return _characters(new, lambda c, i: F.when(upper(F.substring(old, place(i), F.lit(1))), F.upper(c)).otherwise(c))


def _next_given(word: Column, surname: Column, key: str, given: dict[str, list[str]]) -> Column:
    """The name after a listed one in its list's order for a surname; null for other words."""
    out = None
    for names in given.values():
        keyed = F.array_sort(F.transform(F.array(*map(F.lit, names)), lambda n: F.struct(F.sha2(F.concat_ws("|", F.lit(key), surname, n), 256).alias("h"), n.alias("n"))))
        order = F.transform(keyed, lambda x: x["n"])
        chosen = F.get(order, (F.array_position(order, word) % len(names)).cast("int"))
        out = F.when(word.isin(*names), chosen) if out is None else out.when(word.isin(*names), chosen)
    return out


def _initial(word: Column, surname: Column, key: str) -> Column:
    """An initial, turned round its alphabet by a number that hangs on the surname."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("initial"), surname), 256)
    out, letter = None, F.lower(F.substring(word, 1, 1))
    for vowels, consonants in SCRIPTS.values():
        alphabet = "".join(sorted(vowels + consonants))
        turn = (F.instr(F.lit(alphabet), letter) + _number(digest, F.lit(0), len(alphabet) - 1)) % len(alphabet)
        chosen = F.concat(F.upper(F.substring(F.lit(alphabet), turn + 1, F.lit(1))), F.lit("."))
        out = F.when(F.lit(alphabet).contains(letter), chosen) if out is None else out.when(F.lit(alphabet).contains(letter), chosen)
    return out.otherwise(word)


def _written_as(row: dict[str, Column], key: str, given: dict[str, list[str]]) -> Column:
    """A surrogate in the format of a mention; row: kind, mention, entity, new, and new_other for an unlisted given name."""
    kind, mention, entity, new = (row[c] for c in ("kind", "mention", "entity", "new"))
    nth = lambda i, kept: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), kept, ""))
    digits = _characters(mention, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(new, nth(i, "[^0-9]"), F.lit(1))).otherwise(c))
    iban = _characters(mention, lambda c, i: F.when(c != " ", F.upper(F.substring(new, nth(i, " "), F.lit(1)))).otherwise(c))
    words = F.split(mention, " ")
    kept = lambda w: w.rlike(rf"^(?:{'|'.join(TITLES)})\.?$") | w.isin(*PARTICLES)

    def renamed(w: Column, i: Column) -> Column:
        upper = F.when((F.upper(w) == w) & (F.length(w) > 1), True).otherwise(False)
        other = _next_given(F.initcap(w), entity, key, given)
        return (
            F.when(i == F.size(words) - 1, _cased(new, w)).when(kept(w), w).when(w.rlike(r"^\p{Lu}\.$"), _initial(w, entity, key))
            .when(other.isNotNull(), F.when(upper, F.upper(other)).otherwise(other)).otherwise(_cased(F.coalesce(row["new_other"], w), w))
        )

    name = F.array_join(F.transform(words, renamed), " ")
    return F.when(kind.isin("email", "ipv6"), _cased(new, mention)).when(kind == "ip", new).when(kind == "iban", iban).when(kind == "name", name).otherwise(digits)


def _unlisted(kind: Column, mention: Column, given: dict[str, list[str]]) -> Column:
    """The given name of a mention that no list holds, in lower case; null where there is none."""
    listed = sorted({n for names in given.values() for n in names})
    words = F.split(mention, " ")
    left = F.filter(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: ~(w.rlike(rf"^(?:(?:{'|'.join(TITLES)})\.?|\p{{Lu}}\.)$") | w.isin(*PARTICLES) | F.initcap(w).isin(*listed)))
    return F.when(kind == "name", F.lower(F.get(left, F.lit(0))))


def _bare(mentions: Column, own: dict[str, str]) -> Column:
    """What a search takes besides, to find the surnames of a text's mentions by themselves; empty if there are none."""
    found = F.transform(F.filter(mentions, lambda m: m.rlike(f"^(?:{own['name']})$")), _last_word)
    forms = F.array_distinct(F.flatten(F.transform(F.filter(found, lambda w: F.length(w) >= LEAST_BARE), lambda w: F.array(w, F.upper(w), F.initcap(w)))))
    quoted = F.array_join(F.transform(forms, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")
    return F.when(F.size(forms) > 0, F.concat(F.lit(r"|(?<!\p{L})(?:"), quoted, F.lit(r")(?!\p{L})"))).otherwise("")


def replace_personal(docs: DataFrame, key: str, given: dict[str, list[str]] | None = None) -> DataFrame:
    """docs with the personal data in text replaced; given: lists of given names, each list of one gender and script."""
    given = given or GIVEN
    own, (every, plain) = patterns(given), searches(given)
    row, found, bare, news, of_row = free_names(docs, "row_number", "mentions", "bare", "news", "of_row")
    mentions = F.when(F.col("text").rlike(RARE), F.regexp_extract_all("text", F.lit(every), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(plain), F.lit(0)))
    searched = docs.withColumn(found, F.coalesce(mentions, F.array().cast("array<string>"))).withColumn(row, F.monotonically_increasing_id())
    searched = written(searched)
    hit = searched.where(F.size(found) > 0).withColumn(bare, _bare(F.col(found), own))
    again = F.when(F.col(bare) == "", F.col(found)).otherwise(F.regexp_extract_all("text", F.concat(F.lit(every), F.col(bare)), F.lit(0)))
    rows = hit.select(F.col(row).alias("row"), F.posexplode(again).alias("at", "mention"))
    rows = rows.withColumn("kind", _kind(F.col("mention"), own)).withColumn("after", _after_card(F.col("kind"), F.col("mention")))
    rows = rows.withColumn("mention", F.substring("mention", F.lit(1), F.length("mention") - F.length("after"))).withColumn("entity", _entity(F.col("kind"), F.col("mention")))
    rows = written(rows.withColumn("other", _unlisted(F.col("kind"), F.col("mention"), given)))
    names = rows.where(F.col("other").isNotNull()).select("kind", F.col("other").alias("entity"))
    surrogates = assign(written(rows.select("kind", "entity").unionByName(names).distinct()), key)
    others = surrogates.where("kind = 'name'").select(F.col("entity").alias("other"), F.col("surrogate").alias("new_other"))
    given_new = rows.join(surrogates.withColumnRenamed("surrogate", "new"), ["kind", "entity"]).join(others, "other", "left")
    new = _written_as({c: F.col(c) for c in ("kind", "mention", "entity", "new", "new_other")}, key, given)
    lists = given_new.select("row", "at", F.concat(new, F.col("after")).alias("new")).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias(news))
    pieces = F.split("text", F.concat(F.lit(every), F.col(bare)), -1)
    text = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(news, i), F.lit("")))), "")
    changed = hit.join(lists.withColumnRenamed("row", of_row), F.col(row) == F.col(of_row)).withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return searched.where(F.size(found) == 0).select(*docs.columns).unionByName(changed.select(*docs.columns))
