"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A text is cut at its candidates (one pattern of alternatives); each candidate that passes the validation of its kind is
replaced, all else stays as it is, character for character. A value is read as a row of symbols, each with its own
radix: digits 10, letters 26 per case, hexadecimal digits 16, the parts of an address or date their ranges, punctuation
1. The left and right halves are added to in turn, modulo the radix, with a keyed hash of the other half. The halves are
cut in the middle of the row; for e-mail addresses, and where that leaves one half without a symbol that can change, in
the middle of the symbols that can. A single such symbol first goes through a keyed order of its values. That is a
permutation of the values of one format, so equal values stay equal across all documents and different ones different.
Check digits are computed anew. Letters and digits beyond ASCII are permuted within their stretch of SCRIPTS; the rare
letters that no stretch holds stay as they are.

=========  ==========================================  ==================================================
kind       valid when                                  what is permuted
=========  ==========================================  ==================================================
email      local part, @, dotted domain                the local part's letters and digits, within their script
secret     16 or more letters, after token =, ...      all letters and digits
iban       remainder 1 modulo 97                       the account part; check digits follow
ip         four numbers up to 255, no version named    the four numbers
phone      international or 3-3-4 grouping             the digits after the country code of the numbering plan
ssn        area, group and serial in use               the three numbers, within those in use
date       a day of 1900-2099                          the day
card       13 to 19 digits, Luhn sum 0                 all digits but the last; the last follows
=========  ==========================================  ==================================================

Everything is an expression on one row: nothing is shuffled or sent to Python.

Cases: a null text stays null and an empty one empty, both with 0 replacements. Only the text column is changed; all other
columns are carried through, whatever their names. Rows that repeat are changed alike. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

ROUNDS = 8
_DAYS = (229, 319)  # 73 051 days from 1900-01-01: the two centuries have 73 049, the last two ranks are never read

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*(?<=\.[A-Za-z]{2,24})"
SECRET = r"(?<=(?i:token|secret|password|passwd|api_key|apikey|api-key) {0,2}[=:] {0,2}[\"']?)[A-Za-z0-9+/_\-]{16,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?<!\b(?i:v|ver|version|release|build)[.: ]{0,2})[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PHONE = (r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])"
         r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9])")
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}( |-)[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])"
#: The card pattern has the only group.
CANDIDATE = "|".join((EMAIL, SECRET, IBAN, IP, PHONE, SSN, DATE, CARD))
#: A text without this has no candidates.
HINT = r"[0-9@]|(?i:token|secret|passw|api.?key)"
DATE_FORMATS = {r"^[0-9]{4}-": "yyyy-MM-dd", r"^[0-9]{4}/": "yyyy/MM/dd", r"^[0-9]{2}\.": "dd.MM.yyyy", r"^[0-9]{2}/": "dd/MM/yyyy"}

#: Stretches of letters, or of digits, of one script and case without gaps, as code points.
SCRIPTS = (
    (0x00C0, 0x00D6), (0x00D8, 0x00DE), (0x00DF, 0x00F6), (0x00F8, 0x00FF),  # Latin with accents
    (0x0100, 0x017F), (0x1EA0, 0x1EF9),
    (0x0391, 0x03A1), (0x03A3, 0x03AB), (0x03AC, 0x03CE),  # Greek
    (0x0410, 0x042F), (0x0430, 0x044F), (0x0450, 0x045F),  # Cyrillic
    (0x0531, 0x0556), (0x0561, 0x0586),  # Armenian
    (0x05D0, 0x05EA), (0x0620, 0x064A), (0x0660, 0x0669), (0x06F0, 0x06F9),  # Hebrew, Arabic
    (0x0905, 0x0939), (0x0966, 0x096F), (0x0993, 0x09A8), (0x09AA, 0x09B0), (0x09E6, 0x09EF),  # Devanagari, Bengali
    (0x0E01, 0x0E30), (0x10D0, 0x10FA),  # Thai, Georgian
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),  # Kana, Han, Hangul
)
#: The country codes of one, two and three digits.
COUNTRY = "^[+](?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
TEXT_KINDS = "('email', 'secret', 'hex', 'iban', 'phone', 'card')"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _characters(text: str) -> str:
    return f"array_remove(split({text}, ''), '')"


def _digits_of(text: str) -> str:
    return f"transform({_characters(f'translate({text}, {_quoted(chr(32) + chr(45))}, {_quoted(str())})')}, c -> cast(c as int))"


def _luhn(digits: str, first: int) -> str:
    """SQL: Luhn sum of an array of digits, of which each second is doubled, from the last (0) or the one before (1)."""
    return f"aggregate(transform(reverse({digits}), (d, i) -> if(i % 2 = {first}, if(d >= 5, 2 * d - 9, 2 * d), d)), 0, (a, b) -> a + b)"


def _remainder(text: str) -> str:
    """SQL: an account number modulo 97, letters counting from 10."""
    return f"aggregate({_characters(text)}, 0, (a, c) -> if(c rlike '[0-9]', a * 10 + ascii(c) - 48, a * 100 + ascii(c) - 55) % 97)"


def _script(otherwise: str, of: Callable[[int, int], str]) -> str:
    """SQL: a value of the stretch that holds the character c."""
    return "case " + " ".join(f"when ascii(c) between {a} and {b} then {of(a, b)}" for a, b in SCRIPTS) + f" else {otherwise} end"


def _kind(m: str) -> str:
    whole = {"ip": IP, "ssn": SSN, "date": DATE, "card": CARD, "phone": PHONE, "iban": IBAN}
    return (f"case when contains({m}, '@') then 'email' "
            + " ".join(f"when {m} rlike {_quoted(f'^(?:{p})$')} then '{kind}'" for kind, p in whole.items())
            + f" when {m} rlike '^(?:[0-9a-f]+|[0-9A-F]+)$' then 'hex' else 'secret' end")


def _day(m: str) -> str:
    forms = " ".join(f"when {m} rlike {_quoted(p)} then try_to_timestamp({m}, '{form}')" for p, form in DATE_FORMATS.items())
    return f"datediff(case {forms} end, date'1900-01-01')"


def _valid(e: str) -> str:
    m = f"{e}.m"
    part = f"transform(split({m}, '[.-]'), x -> try_cast(x as int))"
    bare = f"replace({m}, ' ', '')"
    turned = f"concat(substring({bare}, 5), substring({bare}, 1, 4))"
    return (f"case {e}.kind when 'ip' then array_max({part}) <= 255 "
            f"when 'ssn' then {part}[0] between 1 and 899 and {part}[0] <> 666 and {part}[1] > 0 and {part}[2] > 0 "
            f"when 'date' then {e}.day between 0 and 73048 "
            f"when 'card' then {_luhn(_digits_of(m), 1)} % 10 = 0 "
            f"when 'iban' then {_remainder(turned)} = 1 else true end")


def _steps(key: str) -> list[str]:
    """SQL of the steps from the found candidates to their pseudonyms, each over the array of the step before."""
    fixed = ("case e.kind when 'email' then p >= instr(e.m, '@') - 1 when 'iban' then p < 4 "
             f"when 'phone' then p < length(regexp_extract(e.m, '{COUNTRY}', 0)) else false end")
    letter = ("case when c rlike '[0-9]' then ascii(c) - 48 when c rlike '[a-z]' then ascii(c) - 97 "
              f"when c rlike '[A-Z]' then ascii(c) - 65 else {_script('0', lambda a, b: f'ascii(c) - {a}')} end")
    steps = [
        f"transform(_e, m -> named_struct('m', m, 'kind', {_kind('m')}))",
        f"transform(_e, e -> named_struct('m', e.m, 'kind', e.kind, 'day', if(e.kind = 'date', {_day('e.m')}, null)))",
        f"transform(_e, e -> named_struct('m', e.m, 'day', e.day, 'kind', if({_valid('e')}, e.kind, null)))",
        # Symbols of text kinds; a card's last digit is not among them.
        f"transform(_e, e -> named_struct('m', e.m, 'day', e.day, 'kind', e.kind, 'cs', if(e.kind in {TEXT_KINDS}, "
        + _characters("if(e.kind = 'card', substring(e.m, 1, length(e.m) - 1), e.m)") + ", cast(array() as array<string>))))",
        "transform(_e, e -> named_struct('m', e.m, 'day', e.day, 'kind', e.kind, 'cs', e.cs, 'r', case e.kind "
        f"when 'ip' then array(256, 256, 256, 256) when 'ssn' then array(898, 99, 9999) when 'date' then array({_DAYS[0]}, {_DAYS[1]}) "
        "when 'hex' then transform(e.cs, c -> 16) "
        f"else transform(e.cs, (c, p) -> case when {fixed} then 1 when c rlike '[0-9]' then 10 when c rlike '[a-zA-Z]' then 26 "
        f"when ascii(c) < 128 then 1 else {_script('1', lambda a, b: str(b - a + 1))} end) end))",
        "transform(_e, e -> named_struct('m', e.m, 'kind', e.kind, 'cs', e.cs, 'r', e.r, 'v', case e.kind "
        "when 'ip' then transform(split(e.m, '[.]'), x -> cast(x as int)) "
        "when 'ssn' then transform(transform(split(e.m, '-'), x -> cast(x as int)), (x, i) -> if(i = 0 and x > 666, x - 2, x - 1)) "
        f"when 'date' then array(cast(e.day div {_DAYS[1]} as int), e.day % {_DAYS[1]}) "
        "when 'hex' then transform(e.cs, c -> cast(conv(c, 16, 10) as int)) "
        f"else zip_with(e.cs, e.r, (c, r) -> if(r = 1, 0, {letter})) end))",
    ]
    # p: places of the symbols that can change; h: where the halves are cut.
    steps.append("transform(_e, e -> named_struct('m', e.m, 'kind', e.kind, 'cs', e.cs, 'r', e.r, 'v', e.v, 'p', "
                 "filter(transform(e.r, (x, i) -> if(x > 1, i, -1)), i -> i >= 0)))")
    middle = "size(e.v) div 2"
    lone = (f"array_sort(transform(sequence(0, e.r[e.p[0]] - 1), y -> named_struct('h', sha2(concat_ws('|', {_quoted(key)}, e.kind, "
            "array_join(e.r, ','), 'lone', y), 256), 'y', y)))[x].y")
    steps.append(f"transform(_e, e -> named_struct('m', e.m, 'kind', e.kind, 'cs', e.cs, 'r', e.r, 'h', cast(case when size(e.p) < 2 then {middle} "
                 f"when e.kind <> 'email' and e.p[0] < {middle} and element_at(e.p, -1) >= {middle} then {middle} else e.p[cast(size(e.p) div 2 as int)] end as int), "
                 f"'v', if(size(e.p) = 1, transform(e.v, (x, i) -> if(i = e.p[0], {lone}, x)), e.v)))")
    for k in range(ROUNDS):
        left = k % 2 == 0
        half = "e.h"
        other = f"slice(e.v, cast({half} as int) + 1, size(e.v))" if left else f"slice(e.v, 1, cast({half} as int))"
        changes = f"i < {half}" if left else f"i >= {half}"
        # Formats are apart: the kind and the radices take part in the hash.
        steps.append("transform(_e, e -> named_struct('m', e.m, 'kind', e.kind, 'cs', e.cs, 'r', e.r, 'h', e.h, 'v', e.v, 'g', if(e.kind is null, '', "
                     f"sha2(concat_ws('|', {_quoted(key)}, e.kind, array_join(e.r, ','), '{k}', array_join({other}, ',')), 256))))")
        drawn = "cast(conv(substring(sha2(concat(e.g, ':', i), 256), 1, 12), 16, 10) as bigint)"
        steps.append("transform(_e, e -> named_struct('m', e.m, 'kind', e.kind, 'cs', e.cs, 'r', e.r, 'h', e.h, 'v', transform(e.v, (x, i) -> "
                     f"if({changes} and e.r[i] > 1, cast((x + {drawn}) % e.r[i] as int), x))))")
    symbol = ("case when e.kind = 'hex' then if(e.m = lower(e.m), lower(hex(e.v[p])), hex(e.v[p])) when e.r[p] = 1 then c "
              "when c rlike '[0-9]' then char(48 + e.v[p]) when c rlike '[a-z]' then char(97 + e.v[p]) when c rlike '[A-Z]' then char(65 + e.v[p]) "
              f"else decode(unhex(lpad(hex({_script('0', lambda a, b: str(a))} + e.v[p]), 4, '0')), 'UTF-16BE') end")
    form = " ".join(f"when e.m rlike {_quoted(p)} then date_format(date_add(date'1900-01-01', e.v[0] * {_DAYS[1]} + e.v[1]), '{form}')"
                    for p, form in DATE_FORMATS.items())
    steps.append("transform(_e, e -> named_struct('m', e.m, 'kind', e.kind, 'b', case when e.kind is null then e.m "
                 "when e.kind = 'ip' then array_join(e.v, '.') when e.kind = 'ssn' then concat(lpad(if(e.v[0] >= 665, e.v[0] + 2, e.v[0] + 1), 3, '0'), "
                 "'-', lpad(e.v[1] + 1, 2, '0'), '-', lpad(e.v[2] + 1, 4, '0')) "
                 f"when e.kind = 'date' then case {form} end else array_join(transform(e.cs, (c, p) -> {symbol}), '') end))")
    bare = "replace(e.b, ' ', '')"
    turned = f"concat(substring({bare}, 5), substring({bare}, 1, 2), '00')"
    steps.append(f"transform(_e, e -> case when e.kind = 'card' then concat(e.b, cast((10 - {_luhn(_digits_of('e.b'), 0)} % 10) % 10 as string)) "
                 f"when e.kind = 'iban' then concat(substring(e.b, 1, 2), lpad(98 - {_remainder(turned)}, 2, '0'), substring(e.b, 5)) else e.b end)")
    return steps


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_replaced") -> DataFrame:
    """The same rows with a changed text, and the number of values replaced in it."""
    given = docs.columns
    names = [f"c{i}" for i in range(len(given))]  # the caller's names cannot clash with the steps'
    at = names[given.index(text_col)]
    text = F.col(at)
    rows = docs.toDF(*names)
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_found", found).withColumn("_e", F.col("_found"))
    for step in _steps(key):
        rows = rows.withColumn("_e", F.expr(step))
    rows = rows.withColumn("_n", F.size(F.filter(F.zip_with("_found", "_e", lambda a, b: a != b), lambda x: x)))
    joined = F.array_join(F.zip_with(F.split(text, CANDIDATE, -1), "_e", lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    changed = F.when(F.col("_n") > 0, joined).otherwise(text)
    return rows.select(*[(changed if name == at else F.col(name)).alias(old) for name, old in zip(names, given)],
                       F.when(text.isNull(), 0).otherwise(F.greatest(F.col("_n"), F.lit(0))).alias(count_col))
