"""Surrogates for personal data.

Entities (mail addresses, phone, card, account and social security numbers,
network addresses, secrets, names behind a form of address) are found by one pattern. Each distinct
entity, whatever its spelling, gets one keyed surrogate of its own kind, so
mentions of one entity stay mentions of one entity; surrogates that would
coincide with each other or with a real entity are drawn again until all are
distinct. Mentions keep their format: separators, length, letter case, script
and, for names, gender. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywatch.llm.common import stage

# Patterns per kind, in order of precedence.
_MALE = r"Mr|Herr|Hr|Monsieur|M|Señor|Sr|Don|Signor|господин"
_FEMALE = r"Mrs|Ms|Miss|Frau|Fr|Madame|Mme|Mlle|Señora|Sra|Doña|Signora|госпожа"
_PLAIN = r"Dr|Prof"
_HEX = r"[0-9a-fA-F]{1,4}"
# dates, spans of years, decimals and numbers with groups of thousands have as many digits as phone numbers
_NO_PHONE = (
    r"(?!\d{4}[-./]\d{1,2}[-./]\d{1,2}(?!\d)|\d{1,2}[-./]\d{1,2}[-./]\d{4}(?!\d)|(?:1\d|20)\d\d ?[-/] ?(?:1\d|20)\d\d(?!\d)"
    r"|[1-9]\d{0,2}(?:[.]\d{3})+(?![ .-]?\d)|(?:0|[1-9]\d*)\.\d+(?!\d|[./-]\d))"
)
# after + any layout of 7 to 15 digits; without it the same, where blanks part only numbers with 0 or ( first, or 3-3-4
_PHONE = "|".join([
    r"(?<![\w+])\+\d{1,3}[^\w\n]{1,6}\d{2,4}[^\w\n]{1,6}\d{3}[^\w\n]{1,3}\d{3,4}\b|\(\d{3}\) ?\d{3}-\d{4}\b",
    r"(?<![\w+])\+\d(?:(?:[^\w\n,;:.]{0,6}|\.)\d){6,14}(?!\d)",
    r"(?<![\w.,+/-])" + _NO_PHONE + r"(?:\((?=\d{2,5}\))|(?=0))\d(?:(?:[ .\-/()\u00a0]|\)[ /-]| \(| ?[-/] ?)?\d){6,14}(?!\w|[.,/-]\d)",
    r"(?<![\w.,+/-])\d{3} \d{3}[ -]\d{4}(?!\w|[.,/-]\d)",
    r"(?<![\w.,+/-])" + _NO_PHONE + r"\d(?:[./-]?\d){6,14}(?!\w|[.,/-]\d)",
])
PATTERNS = [
    ("email", r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"\b(?:[0-9a-fA-F]{32,64}|AKIA[0-9A-Z]{16}|(?:sk|ghp|xoxb)[-_][A-Za-z0-9]{20,})\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){1,6}(?: \d[A-Z0-9]{0,2})?)\b"),
    ("card", r"\b\d{4}(?:[ -]?\d{4}){3}\b"),
    ("ssn", r"(?<![\w+.-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})(?![\w-]|[.,]\d)"),
    ("address6", rf"(?<![\w:.])(?=[0-9a-fA-F:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:|::(?:{_HEX}:){{1,6}}{_HEX})(?![\w:])"),
    ("address", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"),
    ("phone", _PHONE),
    ("name", rf"(?<!\w)(?:{_MALE}|{_FEMALE}|{_PLAIN})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"),
]
ROUNDS = 16
# Given names and syllables of surrogates per script and gender.
NAMES = {
    "latin": {
        "m": "Adam Bruno Carl David Erik Felix Georg Henri Ivan Jonas Karl Leon Marc Nils Oscar Paul Ralf Simon Theo Victor".split(),
        "f": "Anna Berta Clara Diana Elena Fiona Greta Helen Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sara Tina Vera".split(),
        "syllables": "ba be bo da de do fa fe ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va".split(),
    },
    "cyrillic": {
        "m": "Антон Борис Виктор Иван Максим Павел Роман Семён".split(),
        "f": "Анна Вера Дина Ирина Мария Нина Ольга Раиса".split(),
        "syllables": "ба бо ва во да до ка ко ла ло ма мо на но ра ро".split(),
    },
}


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words: list[str]) -> str:
    return f"array({', '.join(_q(w) for w in words)})"


PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
_KIND = "CASE " + " ".join(f"WHEN mention RLIKE {_q(f'^(?:{p})$')} THEN '{k}'" for k, p in PATTERNS[:-1]) + " ELSE 'name' END"
_TITLE = rf"^(?:{_MALE}|{_FEMALE}|{_PLAIN})\.? "
_BARE = f"regexp_replace(mention, {_q(_TITLE)}, '')"
# one spelling per entity: digits of numbers, lower case of the rest
_CANON = f"""CASE WHEN kind IN ('card', 'phone', 'ssn') THEN regexp_replace(mention, '[^0-9]', '')
    WHEN kind = 'iban' THEN lower(replace(mention, ' ', ''))
    WHEN kind = 'name' THEN lower({_BARE}) ELSE lower(mention) END"""
_GENDER = f"""CASE WHEN kind != 'name' THEN '' WHEN mention RLIKE {_q(rf'^(?:{_MALE})[. ]')} THEN 'm'
    WHEN mention RLIKE {_q(rf'^(?:{_FEMALE})[. ]')} THEN 'f' ELSE '' END"""


def _byte(at: int) -> str:
    """Two hex digits of the key stream as a number."""
    return f"CAST(conv(substr(stream, {2 * at + 1}, 2), 16, 10) AS INT)"


def _person(script: str) -> str:
    words = NAMES[script]
    given = f"IF(gender = 'f' OR (gender = '' AND {_byte(0)} % 2 = 0), {_array(words['f'])}[{_byte(1)} % {len(words['f'])}], {_array(words['m'])}[{_byte(1)} % {len(words['m'])}])"
    parts = ", ".join(f"{_array(words['syllables'])}[{_byte(k)} % {len(words['syllables'])}]" for k in range(2, 7))
    family = f"initcap(concat({parts}))"
    return f"lower(IF(canon LIKE '% %', concat({given}, ' ', {family}), {family}))"


_DIGITS = "translate(stream, 'abcdef', '012345')"
# a card keeps its first digit and passes the check-sum test when the original does
_LUHN = """pmod(-aggregate(sequence(1, length(body)), 0, (s, i) -> s + IF(i % 2 = length(body) % 2,
    IF(2 * CAST(substr(body, i, 1) AS INT) > 9, 2 * CAST(substr(body, i, 1) AS INT) - 9, 2 * CAST(substr(body, i, 1) AS INT)),
    CAST(substr(body, i, 1) AS INT))), 10)"""

# an account number keeps its country and its letters' places, and gets the check digits of its new body
_ACCOUNT = f"""array_join(transform(sequence(5, length(canon)), i -> IF(substr(canon, i, 1) RLIKE '[0-9]', substr({_DIGITS}, i, 1),
    translate(substr(stream, i, 1), '0123456789abcdef', 'ghijklmnopqrstuv'))), '')"""
_MOD97 = """aggregate(sequence(1, length(account) + 4), 0, (s, i) -> IF(substr(concat(account, substr(canon, 1, 2), '00'), i, 1) RLIKE '[0-9]',
    s * 10 + CAST(substr(concat(account, substr(canon, 1, 2), '00'), i, 1) AS INT), s * 100 + ascii(substr(concat(account, substr(canon, 1, 2), '00'), i, 1)) - 87) % 97)"""


def _draw(entities: DataFrame, key: str) -> DataFrame:
    """The surrogate (in canonical spelling) of each entity for its current attempt."""
    stream = "concat(" + ", ".join(f"sha2(concat_ws('|', {_q(key)}, kind, canon, attempt, {k}), 256)" for k in range(2)) + ")"
    body = entities.selectExpr("kind", "canon", "gender", "attempt", f"{stream} AS stream").selectExpr(
        "*", f"concat(substr(canon, 1, 1), substr({_DIGITS}, 1, length(canon) - 2)) AS body", f"IF(kind = 'iban', {_ACCOUNT}, '') AS account"
    )
    surrogate = f"""CASE kind
      WHEN 'email' THEN concat(translate(substr(stream, 1, 12), '0123456789', 'ghijklmnop'), '@', translate(substr(stream, 20, 6), '0123456789', 'qrstuvwxyz'), '.example.net')
      WHEN 'secret' THEN substr(concat(regexp_extract(canon, '^(akia|(?:sk|ghp|xoxb)[-_])', 1), stream), 1, length(canon))
      WHEN 'card' THEN concat(body, {_LUHN})
      WHEN 'iban' THEN concat(substr(canon, 1, 2), lpad(98 - {_MOD97}, 2, '0'), account)
      WHEN 'address6' THEN array_join(transform(sequence(1, length(canon)), i -> IF(substr(canon, i, 1) = ':', ':', substr(stream, i, 1))), '')
      WHEN IF(kind = 'ssn', 'ssn', 'phone') THEN concat(substr(canon, 1, 1), substr({_DIGITS}, 1, length(canon) - 1))
      WHEN 'address' THEN concat_ws('.', {_byte(0)} % 223 + 1, {_byte(1)}, {_byte(2)}, {_byte(3)})
      ELSE IF(canon RLIKE '[\\\\u0400-\\\\u04ff]', {_person('cyrillic')}, {_person('latin')}) END"""
    return body.selectExpr("kind", "canon", "gender", "attempt", f"{surrogate} AS surrogate")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate: distinct within a kind, and never a real entity of the kind.

    Where a round leaves clashes, the entity first in order keeps the surrogate
    and the others are drawn again. What still clashes after ``ROUNDS`` rounds (a
    kind with more entities than values) becomes its key stream, which is
    distinct though not of the same format.
    """
    drawn = stage(_draw(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    for turn in range(1, ROUNDS + 1):
        order = "ROW_NUMBER() OVER (PARTITION BY kind, surrogate ORDER BY attempt, canon)"
        real = drawn.selectExpr("kind", "canon AS surrogate", "true AS is_real")
        judged = stage(
            drawn.join(real, ["kind", "surrogate"], "left")
            .selectExpr("kind", "canon", "gender", "attempt", "surrogate", f"is_real IS NOT NULL OR {order} > 1 AS clash"),
            "judged",
        )
        if not judged.where("clash").limit(1).count():
            return judged.select("kind", "canon", "surrogate")
        again = _draw(judged.where("clash").withColumn("attempt", F.lit(turn)), key)
        if turn == ROUNDS:
            again = again.withColumn("surrogate", F.expr(f"sha2(concat_ws('|', {_q(key)}, kind, canon), 256)"))
        drawn = stage(judged.where("NOT clash").drop("clash").unionByName(again), "surrogates")
    return drawn.select("kind", "canon", "surrogate")


# digits of the surrogate poured into the mention's own layout
_POURED = """array_join(transform(sequence(1, length(mention)), i -> IF(substr(mention, i, 1) RLIKE '[0-9]',
    substr(surrogate, length(regexp_replace(substr(mention, 1, i), '[^0-9]', '')), 1), substr(mention, i, 1))), '')"""
_SPACED = """array_join(transform(sequence(1, length(mention)), i -> IF(substr(mention, i, 1) = ' ', ' ',
    upper(substr(surrogate, length(replace(substr(mention, 1, i), ' ', '')), 1)))), '')"""
_FORMATTED = f"""CASE WHEN kind = 'iban' AND length(surrogate) = length(canon) THEN {_SPACED}
    WHEN kind IN ('card', 'phone', 'ssn') AND length(surrogate) = length(canon) THEN {_POURED}
    WHEN kind = 'name' THEN concat(regexp_extract(mention, {_q(_TITLE)}, 0), initcap(surrogate))
    WHEN mention = upper(mention) THEN upper(surrogate) ELSE surrogate END"""


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_mentions; one row per document row.

    Null text stays null and empty text empty, with no mentions. Repeated rows
    and null ids are kept and replaced alike. Texts of any length are treated
    whole; an empty table gives no rows; other columns are ignored. The same key
    gives the same surrogates as long as the set of entities is the same.
    """
    pattern = _q(PATTERN)
    # the pattern goes over each text once; quiet texts are kept as they are, the others as pieces between mentions
    found = docs.selectExpr("doc_id", "text", f"inline(array(struct(regexp_extract_all(text, {pattern}, 0) AS mentions)))")
    read = stage(
        found.selectExpr(
            "doc_id", "IF(size(mentions) > 0, NULL, text) AS text", "IF(size(mentions) > 0, xxhash64(text), NULL) AS text_hash",
            "IF(size(mentions) > 0, mentions, NULL) AS mentions", f"IF(size(mentions) > 0, split(text, {pattern}, -1), NULL) AS pieces",
        ),
        "read_texts",
    )
    quiet = read.where("mentions IS NULL").selectExpr("doc_id", "text", "0L AS n_mentions")
    cut = read.where("mentions IS NOT NULL").select("doc_id", "text_hash", "mentions", "pieces")
    mentions = stage(
        cut.selectExpr("doc_id", "text_hash", "posexplode(mentions) AS (at, mention)").distinct()
        .selectExpr("*", f"{_KIND} AS kind").selectExpr("*", f"{_CANON} AS canon", f"{_GENDER} AS gender"),
        "mentions",
    )
    entities = mentions.groupBy("kind", "canon").agg(F.max("gender").alias("gender"))
    mapping = surrogates(entities, key)
    filled = (
        mentions.join(mapping, ["kind", "canon"])
        .selectExpr("doc_id", "text_hash", "at", f"{_FORMATTED} AS put")
        .groupBy("doc_id", "text_hash")
        .agg(F.expr("transform(array_sort(collect_list(struct(at, put))), x -> x.put) AS puts"))
    )
    loud = cut.alias("c").join(filled.alias("f"), F.expr("c.doc_id <=> f.doc_id AND c.text_hash = f.text_hash"), "left").selectExpr(
        "c.doc_id",
        "IF(puts IS NULL, pieces[0], array_join(transform(pieces, (p, i) -> IF(i < size(puts), concat(p, puts[i]), p)), '')) AS text",
        "CAST(size(mentions) AS BIGINT) AS n_mentions",
    )
    return quiet.unionByName(loud)
