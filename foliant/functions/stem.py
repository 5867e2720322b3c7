"""English stems by the published Porter2 rules, for lower-case tokens of letters and digits (no apostrophes).

Every rule is one SQL expression over the columns before it, in the functions that Spark and DuckDB share, so the same
steps run as column expressions here and as nested selects in an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The published rule tables.
VOWEL = "[aeiouy]"
CONSONANT = "[^aeiouy]"
DOUBLES = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
SHORT_END = "(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)"
LI_ENDINGS = "[cdeghkmnrt]$"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news",
    "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = "inning outing canning herring earring proceed exceed succeed".split()
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic",
    "ness": "", "ful": "",
}
STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
    "al", "er", "ic",
)
SPARK, DUCK = "spark", "duck"


def _cut(column: str, n: int) -> str:
    return f"substr({column}, 1, length({column}) - {n})"


def _ends(column: str, suffix: str) -> str:
    return f"{column} LIKE '%{suffix}'"


def _suffix_step(column: str, rules: dict[str, str], region: dict[str, str], extra: dict[str, str]) -> str:
    """The longest suffix decides: replaced when it lies in its region and the letters before it allow it."""
    cases = []
    for suffix in sorted(rules, key=len, reverse=True):
        n, base = len(suffix), _cut(column, len(suffix))
        allowed = f"length({column}) - {n} >= {region.get(suffix, region[''])}"
        if suffix in extra:
            allowed += f" AND {extra[suffix].replace('@', base)}"
        cases.append(f"WHEN {_ends(column, suffix)} THEN CASE WHEN {allowed} THEN concat({base}, '{rules[suffix]}') ELSE {column} END")
    return f"CASE {' '.join(cases)} ELSE {column} END"


def stem_steps(word: str, dialect: str = SPARK) -> list[tuple[str, str]]:
    """(column, expression) pairs in order; the last column, ``stem``, holds the stem of ``word``."""
    duck = dialect == DUCK

    def has(column: str, pattern: str) -> str:
        return f"regexp_matches({column}, '{pattern}')" if duck else f"{column} RLIKE '{pattern}'"

    def after(column: str) -> str:
        return f"length(regexp_extract({column}, '^.*?{VOWEL}{CONSONANT}', 0))"

    marked = f"regexp_replace({word}, '^y', 'Y')"
    marked = f"regexp_replace({marked}, '([aeiouy])y', '\\1Y', 'g')" if duck else f"regexp_replace({marked}, '([aeiouy])y', '$1Y')"
    whole = " ".join(f"WHEN {word} = '{a}' THEN '{b}'" for a, b in WHOLE.items())
    kept = ", ".join(f"'{w}'" for w in KEPT_AFTER_1A)
    steps = [
        ("s_m", marked),
        (
            "s_r1",
            f"CASE WHEN {has('s_m', '^(gener|arsen)')} THEN 5 WHEN {has('s_m', '^commun')} THEN 6 "
            f"WHEN {has('s_m', VOWEL + CONSONANT)} THEN {after('s_m')} ELSE length(s_m) END",
        ),
        ("s_rest", "substr(s_m, s_r1 + 1)"),
        ("s_r2", f"CASE WHEN {has('s_rest', VOWEL + CONSONANT)} THEN s_r1 + {after('s_rest')} ELSE length(s_m) END"),
        (
            "s_1a",
            f"CASE WHEN {_ends('s_m', 'sses')} THEN {_cut('s_m', 2)} "
            f"WHEN {has('s_m', 'ie[ds]$')} THEN CASE WHEN length(s_m) > 4 THEN {_cut('s_m', 2)} ELSE {_cut('s_m', 1)} END "
            f"WHEN {has('s_m', '[^us]s$')} AND {has(_cut('s_m', 2), VOWEL)} THEN {_cut('s_m', 1)} ELSE s_m END",
        ),
        (
            "s_base",
            "CASE "
            + " ".join(f"WHEN {_ends('s_1a', s)} THEN {_cut('s_1a', len(s))}" for s in ("ingly", "edly", "ing", "ed"))
            + " ELSE '' END",
        ),
        (
            "s_1b",
            f"CASE WHEN {_ends('s_1a', 'eedly')} THEN CASE WHEN length(s_1a) - 5 >= s_r1 THEN {_cut('s_1a', 3)} ELSE s_1a END "
            f"WHEN {_ends('s_1a', 'eed')} THEN CASE WHEN length(s_1a) - 3 >= s_r1 THEN {_cut('s_1a', 1)} ELSE s_1a END "
            f"WHEN {has('s_base', VOWEL)} THEN CASE WHEN {has('s_base', '(at|bl|iz)$')} THEN concat(s_base, 'e') "
            f"WHEN {has('s_base', DOUBLES)} THEN {_cut('s_base', 1)} "
            f"WHEN s_r1 >= length(s_base) AND {has('s_base', SHORT_END)} THEN concat(s_base, 'e') ELSE s_base END ELSE s_1a END",
        ),
        ("s_1c", f"CASE WHEN {has('s_1b', '^.+' + CONSONANT + '[yY]$')} THEN concat({_cut('s_1b', 1)}, 'i') ELSE s_1b END"),
        ("s_2", _suffix_step("s_1c", STEP2, {"": "s_r1"}, {"ogi": _ends("@", "l"), "li": has("@", LI_ENDINGS)})),
        ("s_3", _suffix_step("s_2", STEP3, {"": "s_r1", "ative": "s_r2"}, {})),
        ("s_4", _suffix_step("s_3", dict.fromkeys(STEP4, ""), {"": "s_r2"}, {"ion": has("@", "[st]$")})),
        (
            "s_5",
            f"CASE WHEN {_ends('s_4', 'e')} THEN CASE WHEN length(s_4) - 1 >= s_r2 OR (length(s_4) - 1 >= s_r1 AND NOT {has(_cut('s_4', 1), SHORT_END)}) "
            f"THEN {_cut('s_4', 1)} ELSE s_4 END WHEN {_ends('s_4', 'll')} AND length(s_4) - 1 >= s_r2 THEN {_cut('s_4', 1)} ELSE s_4 END",
        ),
        (
            "stem",
            f"CASE WHEN length({word}) <= 2 THEN {word} {whole} WHEN s_1a IN ({kept}) THEN s_1a ELSE replace(s_5, 'Y', 'y') END",
        ),
    ]
    return steps


def with_stem(rows: DataFrame, word: str) -> DataFrame:
    """Add ``stem`` of a word column."""
    columns = rows.columns
    for name, expression in stem_steps(word):
        rows = rows.withColumn(name, F.expr(expression))
    return rows.select(*[c for c in columns if c != "stem"], "stem")


def stem_query(table: str, word: str) -> str:
    """DuckDB: the rows of a table expression with ``stem`` and the columns of the steps."""
    for name, expression in stem_steps(word, DUCK):
        table = f"(SELECT *, {expression} AS {name} FROM {table})"
    return table


def stems_of(spark: SparkSession, words: list[str]) -> list[str]:
    """Stems of a handful of query words; a local table that is evaluated where the plan is made, without a job."""
    if not words:
        return []
    rows = spark.createDataFrame(list(enumerate(words)), "n INT, word STRING")
    return [r["stem"] for r in sorted(with_stem(rows, "word").collect())]

