"""Operator 7: format-preserving pseudonyms for personal data, in DataFrame and SQL functions alone.

What is found, and what it has to be:
  email   an address; gets a keyed pseudonym of the same form (letters and digits of the md5), not reversible
  ip      an IPv4 address: four numbers up to 255, the first not 0
  card    13 to 19 digits with a valid Luhn sum; the new number's is valid too. In a stretch of groups of digits the usual
          forms (unbroken, 4-4-4-4, 4-4-4-4-3, 4-6-4, 4-6-5) come first, then groups of 3 digits on, then the whole stretch
  phone   a number of North American form: any area and exchange after 1 or +1, areas from 100 on without it
  ssn     ddd-dd-dddd with valid area, group and serial
  date    yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy or mm/dd/yyyy, a day of 1900 to 2099

The valid values of a format are numbered 0 to a*b - 1, written as two digits x*b + y, and permuted by a Feistel network:
eight rounds add a keyed hash of one digit to the other, modulo a or b in turn. That is a bijection on the valid values,
so equal values stay equal in all documents, different ones stay different, and the result is valid again. Dates are
permuted within their century, which has 36,524 = 92 * 397 (1900s) or 36,525 = 75 * 487 (2000s) days. Phones are permuted
within three sets: areas and exchanges from 100 on, exchanges below 100, and areas below 100. Separators stay.

Edge cases: null texts stay null; texts without such data stay as they are; invalid numbers and dates stay; repeated
rows give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tables

OTHERS = (
    r"(?<![\w.+-])[\w.+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    r"|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
    r"|(?<![\d.-])\d{4}[-/]\d{1,2}[-/]\d{1,2}(?![\d-])"
    r"|(?<![\d.])\d{1,2}\.\d{1,2}\.\d{4}(?![\d]|\.\d)"
    r"|(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])"
    r"|(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
    r"|(?<![\d+-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])"
)
# Last, a stretch of groups of digits that may hold cards; it ends where another format begins.
PATTERN = OTHERS + rf"|(?<![\d-])(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?=\d)(?!{OTHERS})\d++)*+"
USUAL = "^([0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}([ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
ROUNDS = 8


def feistel(number: str, a: int | str, b: int | str, tweak: str) -> str:
    """SQL for the permuted `number` of 0 to a*b - 1; `tweak` is SQL for what makes the permutation its own."""
    mix = lambda other, m: f"cast(conv(substring(md5(concat_ws('|', {tweak}, i, {other})), 1, 14), 16, 10) as bigint) % ({m})"
    step = f"if(i % 2 = 0, named_struct('x', (s.x + {mix('s.y', a)}) % ({a}), 'y', s.y), named_struct('x', s.x, 'y', (s.y + {mix('s.x', b)}) % ({b})))"
    start = f"named_struct('x', cast(({number}) div ({b}) as bigint), 'y', cast(({number}) % ({b}) as bigint))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> {step}, s -> s.x * ({b}) + s.y)"


def refill(old: str, digits: str) -> str:
    """SQL for `old` with its digits replaced by those of `digits`, in turn."""
    return f"array_join(transform(sequence(1, length({old})), p -> if(substring({old}, p, 1) rlike '[0-9]', substring({digits}, length(regexp_replace(substring({old}, 1, p), '[^0-9]', '')), 1), substring({old}, p, 1))), '')"


def luhn_sum(digits: str, shift: int) -> str:
    """SQL for the Luhn sum; `shift` 0 if the check digit is the last of them, 1 if it is still to come."""
    d = f"cast(substring({digits}, length({digits}) - p, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), cast(0 as bigint), (t, p) -> t + if((p + {shift}) % 2 = 1, ({d} * 2) div 10 + ({d} * 2) % 10, {d}))"


def _key(key: str, kind: str) -> str:
    return "'" + key.replace("\\", "").replace("'", "") + f"', '{kind}'"


def _with(value: str, name: str, body: str) -> str:
    """SQL that computes `value` once and uses it as `name` in `body`."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def card(m: str, key: str) -> str:
    head = "substring(d, 1, length(d) - 1)"
    left, right = "cast(pow(10, (length(h)) div 2) as bigint)", "cast(pow(10, length(h) - length(h) div 2) as bigint)"
    new = f"lpad(cast({feistel('cast(h as bigint)', left, right, _key(key, 'card') + ', length(h)')} as string), length(h), '0')"
    checked = _with(new, "n", f"concat(n, cast((10 - {luhn_sum('n', 1)} % 10) % 10 as string))")
    return _with(f"regexp_replace({m}, '[^0-9]', '')", "d", f"if(length(d) between 13 and 19 and {luhn_sum('d', 0)} % 10 = 0, {_with(_with(head, 'h', checked), 'z', refill(m, 'z'))}, {m})")


def pieces(m: str, key: str) -> str:
    """SQL for the stretch `m` as (old, new) pieces in turn. Candidates begin and end with a group; those of the usual
    forms are taken first, then the leftmost and longest, and none overlaps another."""
    c = f"substring({m}, p, l)"
    digits = f"regexp_replace({c}, '[^0-9]', '')"
    whole = f"p = 1 and l = length({m})"
    fits = f"substring({m}, p + l - 1, 1) rlike '[0-9]' and not substring({m}, p + l, 1) rlike '[0-9]' and length({digits}) between 13 and 19"
    form = f"{c} rlike '{USUAL}' or not {c} rlike '(^|[ -])[0-9]{{1,2}}([ -]|$)' or ({whole})"
    valid = _with(digits, "d", f"{luhn_sum('d', 0)} % 10 = 0")
    starts = f"filter(sequence(1, length({m})), p -> substring({m}, p, 1) rlike '[0-9]' and (p = 1 or not substring({m}, p - 1, 1) rlike '[0-9]'))"
    lengths = f"filter(sequence(13, 37), l -> p + l - 1 <= length({m}) and {fits} and ({form}) and {valid})"
    found = f"array_sort(flatten(transform({starts}, p -> transform({lengths}, l -> named_struct('rank', if({c} rlike '{USUAL}', 0, 1), 'p', p, 'less', -l, 'l', l)))))"
    none = "cast(array() as array<struct<p: int, l: int>>)"
    chosen = f"array_sort(aggregate({found}, {none}, (t, x) -> if(exists(t, y -> y.p < x.p + x.l and x.p < y.p + y.l), t, concat(t, array(named_struct('p', x.p, 'l', x.l))))))"
    start = "named_struct('at', 1, 'out', cast(array() as array<struct<old: string, new: string>>))"
    gap, one = f"substring({m}, s.at, x.p - s.at)", f"substring({m}, x.p, x.l)"
    step = f"named_struct('at', x.p + x.l, 'out', concat(s.out, array(named_struct('old', {gap}, 'new', {gap}), {_with(one, 'w', f"named_struct('old', w, 'new', {card('w', key)})")})))"
    rest = f"substring({m}, s.at)"
    return f"aggregate({chosen}, {start}, (s, x) -> {step}, s -> concat(s.out, array(named_struct('old', {rest}, 'new', {rest}))))"


def phone(m: str, key: str) -> str:
    """A number with an area below 100 needs the 1 or +1 before it to be one."""
    part = lambda a, n: f"cast(substring(d, {a}, {n}) as bigint)"

    def permuted(area: int, exchange: int, exchanges: int, a: int, b: int, kind: str) -> str:
        number = f"(({part(1, 3)} - {area}) * {exchanges} + ({part(4, 3)} - {exchange})) * 10000 + {part(7, 4)}"
        digits = f"concat(lpad(cast(q div {exchanges * 10000} + {area} as string), 3, '0'), lpad(cast((q div 10000) % {exchanges} + {exchange} as string), 3, '0'), lpad(cast(q % 10000 as string), 4, '0'))"
        return _with(feistel(number, a, b, _key(key, kind)), "q", digits)

    new = (
        f"case when substring(d, 1, 1) = '0' then {permuted(0, 0, 1000, 40000, 25000, 'phone0')} "
        f"when substring(d, 4, 1) = '0' then {permuted(100, 0, 100, 30000, 30000, 'phone1')} else {permuted(100, 100, 900, 90000, 90000, 'phone')} end"
    )
    valid = "length(d) = 10 and (length(e) = 11 or substring(d, 1, 1) >= '1')"
    return _with(f"regexp_replace({m}, '[^0-9]', '')", "e", _with("right(e, 10)", "d", f"if({valid}, {_with(f'concat(left(e, length(e) - 10), {new})', 'z', refill(m, 'z'))}, {m})"))


def ip(m: str, key: str) -> str:
    number = "o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3] - 16777216"
    new = _with(feistel(number, 255 * 256, 65536, _key(key, "ip")) + " + 16777216", "q", "concat_ws('.', q div 16777216, (q div 65536) % 256, (q div 256) % 256, q % 256)")
    return _with(f"transform(split({m}, '[.]'), x -> cast(x as bigint))", "o", f"if(array_max(o) <= 255 and o[0] >= 1, {new}, {m})")


def ssn(m: str, key: str) -> str:
    number = "((a - if(a > 666, 2, 1)) * 99 + (g - 1)) * 9999 + (r - 1)"
    new = _with(feistel(number, 898 * 99, 9999, _key(key, "ssn")), "q", _with("q div 989901 + 1", "v", "concat_ws('-', lpad(cast(if(v >= 666, v + 1, v) as string), 3, '0'), lpad(cast((q div 9999) % 99 + 1 as string), 2, '0'), lpad(cast(q % 9999 + 1 as string), 4, '0'))"))
    valid = "a between 1 and 899 and a <> 666 and g > 0 and r > 0"
    part = lambda a, n: f"cast(substring({m}, {a}, {n}) as bigint)"
    return _with(part(1, 3), "a", _with(part(5, 2), "g", _with(part(8, 4), "r", f"if({valid}, {new}, {m})")))


def date(m: str, key: str, fmt: str, order: tuple[int, int, int]) -> str:
    """`order`: which of the three numbers are year, month and day; `fmt` prints a date in this format."""
    p = [f"cast(element_at(regexp_extract_all({m}, '[0-9]+', 0), {i}) as int)" for i in order]
    parsed = f"try_to_timestamp(concat_ws('-', lpad(cast({p[0]} as string), 4, '0'), lpad(cast({p[1]} as string), 2, '0'), lpad(cast({p[2]} as string), 2, '0')), 'yyyy-MM-dd')"
    first = "if(year(t) < 2000, date'1900-01-01', date'2000-01-01')"
    old, new = "datediff(to_date(t), date'1900-01-01')", "datediff(to_date(t), date'2000-01-01')"
    day = f"if(year(t) < 2000, {feistel(old, 92, 397, _key(key, 'date19'))}, {feistel(new, 75, 487, _key(key, 'date20'))})"
    return _with(parsed, "t", f"if(t is not null and year(t) between 1900 and 2099, date_format(date_add({first}, cast({day} as int)), '{fmt}'), {m})")


def email(m: str, key: str) -> str:
    return _with(f"md5(concat_ws('|', {_key(key, 'email')}, lower({m})))", "h", "concat('u', substring(h, 1, 12), '@m', substring(h, 13, 8), '.example')")


def pseudonym(m: str, key: str) -> str:
    """SQL for what stands for the match `m`."""
    slash = f"regexp_count({m}, '/')"
    return (
        f"case when contains({m}, '@') then {email(m, key)} when {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then {ip(m, key)} "
        f"when {m} rlike '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$' then {date(m, key, 'yyyy-MM-dd', (1, 2, 3))} "
        f"when {m} rlike '^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}$' then {date(m, key, 'yyyy/MM/dd', (1, 2, 3))} "
        f"when {m} rlike '^[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}}$' then {date(m, key, 'dd.MM.yyyy', (3, 2, 1))} "
        f"when {slash} = 2 then {date(m, key, 'MM/dd/yyyy', (3, 1, 2))} "
        f"when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {ssn(m, key)} "
        f"else {phone(m, key)} end"
    )


def pseudonymise(docs: DataFrame, key: str = "lexloom") -> DataFrame:
    """doc_id, text with pseudonyms, n_found (valid values of the formats above that changed) and pseudonyms, for each row.

    `key` is the secret: give each corpus its own."""
    rows = docs.select("doc_id", "text")
    may = F.col("text").rlike("[0-9]{2}|@|[0-9][.][0-9]")
    quoted = PATTERN.replace("\\", "\\\\")
    rows = rows.withColumn("found", F.when(may, F.expr(f"regexp_extract_all(text, '{quoted}', 0)")))
    rows = rows.withColumn("parts", F.when(F.size("found") > 0, F.expr(f"split(text, '{quoted}', -1)")))
    one = f"if(m rlike '^[0-9]+([ -][0-9]+)*$' and length(regexp_replace(m, '[^0-9]', '')) >= 13, {pieces('m', key)}, array(named_struct('old', m, 'new', {pseudonym('m', key)})))"
    rows = rows.withColumn("new", F.when(F.size("found") > 0, F.expr(f"transform(found, m -> {one})")))
    joined = "zip_with(slice(parts, 1, size(found)), new, (p, m) -> concat(p, array_join(transform(m, x -> x.new), '')))"
    text = F.when(F.size("found") > 0, F.expr(f"concat(array_join({joined}, ''), element_at(parts, -1))")).otherwise(F.col("text"))
    changed = F.expr("transform(filter(flatten(new), x -> x.old <> x.new), x -> x.new)")
    return rows.select("doc_id", text.alias("text"), F.coalesce(F.size(changed), F.lit(0)).cast("long").alias("n_found"), F.coalesce(changed, F.array().cast("array<string>")).alias("pseudonyms"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(tables(spark, sf_dir, "documents"), spark.conf.get("lexloom.pseudonyms.key", "lexloom"))
