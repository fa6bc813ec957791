"""Format-preserving pseudonyms for private values by a keyed Feistel permutation.

Validated numbers and dates are moved along the cycle of a keyed permutation of all
values of their format, so equal values stay equal in all documents, different values
stay different, and no value keeps itself. Everything is an SQL expression over the
text column: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import whole_row

#: Rounds of the Feistel network.
ROUNDS = 8
#: Characters that are permuted together; longer runs are cut.
RUN = 20
#: Dates from this day on, 450 x 450 of them, are permuted among themselves.
FIRST_DAY, DAY_PARTS = "1600-01-01", 450
DIGITS, HEX, LETTERS = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"

#: What is looked for, by kind. The first kind that fits at a place wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![A-Za-z0-9])(?i:token|password|passwd|secret|api[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9_+/-]{8,}",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?<![\d.-])(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w+])\+\d{8,15}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}


def _let(value: str, name: str, body: str) -> str:
    """SQL of a body that reads a value by a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


class Permuter:
    """Builds the SQL of keyed permutations. Names of inner variables are numbered, so
    that expressions may hold each other."""

    def __init__(self, key: str):
        self.key = "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"
        self.names = 0

    def name(self) -> str:
        self.names += 1
        return f"v{self.names}"

    def round(self, tweak: str, i: str, x: str) -> str:
        mixed = f"sha2(concat_ws(':', {self.key}, {tweak}, cast({i} as string), cast({x} as string)), 256)"
        return f"cast(conv(substr({mixed}, 1, 15), 16, 10) as bigint)"

    def following(self, a: str, b: str, mu: str, mv: str, tweak: str) -> str:
        """Encrypt the pair (``a`` under ``mu``, ``b`` under ``mv``), add one, decrypt:
        a permutation of all pairs without a fixed point (if there are two or more)."""
        s, i, e = self.name(), self.name(), self.name()
        start = f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint))"
        there = (
            f"aggregate(sequence(0, {ROUNDS - 1}), {start}, ({s}, {i}) -> named_struct('a', {s}.b, 'b', "
            f"pmod({s}.a + {self.round(tweak, i, f'{s}.b')}, if({i} % 2 = 0, {mu}, {mv}))))"
        )
        step = _let(
            there,
            e,
            f"named_struct('a', if({e}.b + 1 = {mv}, pmod({e}.a + 1, {mu}), {e}.a), 'b', pmod({e}.b + 1, {mv}))",
        )
        return (
            f"aggregate(sequence({ROUNDS - 1}, 0, -1), {step}, ({s}, {i}) -> named_struct("
            f"'a', pmod({s}.b - {self.round(tweak, i, f'{s}.a')}, if({i} % 2 = 0, {mu}, {mv})), 'b', {s}.a))"
        )

    def number(self, text: str, alphabet: str) -> str:
        n, c = self.name(), self.name()
        return f"aggregate(split({text}, ''), 0L, ({n}, {c}) -> if({c} = '', {n}, {n} * {len(alphabet)}L + locate({c}, '{alphabet}') - 1))"

    def written(self, number: str, length: str, alphabet: str) -> str:
        s, k = self.name(), self.name()
        digit = f"substr('{alphabet}', cast({s}.n % {len(alphabet)} as int) + 1, 1)"
        built = (
            f"aggregate(sequence(1, {length}), named_struct('n', {number}, 's', ''), ({s}, {k}) -> "
            f"named_struct('n', {s}.n div {len(alphabet)}L, 's', concat({digit}, {s}.s)), {s} -> {s}.s)"
        )
        return f"if({length} = 0, '', {built})"

    def run(self, text: str, alphabet: str, tweak: str) -> str:
        """At most ``RUN`` characters of the alphabet, as as many others."""
        t, u, v, p = (self.name() for _ in range(4))
        size = f"cast(power({len(alphabet)}, {{}}) as bigint)"
        moved = self.following(
            self.number(f"substr({t}, 1, {u})", alphabet),
            self.number(f"substr({t}, {u} + 1)", alphabet),
            size.format(u),
            size.format(v),
            f"concat({tweak}, cast(length({t}) as string))",
        )
        both = f"concat({self.written(f'{p}.a', u, alphabet)}, {self.written(f'{p}.b', v, alphabet)})"
        inner = _let(f"length({t}) - {u}", v, _let(moved, p, both))
        return f"if({text} = '', '', {_let(text, t, _let(f'cast(length({t}) div 2 as int)', u, inner))})"

    def long_run(self, text: str, alphabet: str, tweak: str) -> str:
        t, k = self.name(), self.name()
        part = self.run(f"substr({t}, {k} * {RUN} + 1, {RUN})", alphabet, f"concat({tweak}, cast({k} as string), '.')")
        return _let(text, t, f"array_join(transform(sequence(0, cast(length({t}) div {RUN} as int)), {k} -> {part}), '')")

    def put(self, shape: str, chars: str, fits: str) -> str:
        """``shape`` with its characters that match ``fits`` replaced in turn; capitals stay capitals."""
        s, c, n = self.name(), self.name(), self.name()
        new = f"substr({n}, {s}.k, 1)"
        return _let(
            chars,
            n,
            f"aggregate(split({shape}, ''), named_struct('o', '', 'k', 1), ({s}, {c}) -> if({c} rlike '{fits}', named_struct("
            f"'o', concat({s}.o, if({c} rlike '[A-Z]', upper({new}), {new})), 'k', {s}.k + 1), "
            f"named_struct('o', concat({s}.o, {c}), 'k', {s}.k)), {s} -> {s}.o)",
        )

    def digits(self, value: str, tweak: str) -> str:
        plain = f"regexp_replace({value}, '[^0-9]', '')"
        return self.put(value, self.long_run(plain, DIGITS, tweak), "[0-9]")

    def letters(self, value: str, tweak: str) -> str:
        plain = f"lower(regexp_replace({value}, '[^A-Za-z]', ''))"
        return self.put(value, self.long_run(plain, LETTERS, tweak), "[A-Za-z]")

    def email(self, m: str) -> str:
        """Letters and digits of the local part; the domain stays."""
        local = f"substring_index({m}, '@', 1)"
        x = self.name()
        changed = _let(self.letters(local, "'email'"), x, self.digits(x, "'email'"))
        return f"concat({changed}, '@', substring_index({m}, '@', -1))"

    def secret(self, m: str) -> str:
        """The value after the sign; hexadecimal values stay hexadecimal."""
        h, x, y = self.name(), self.name(), self.name()
        head = f"regexp_extract({m}, '^([^=:]*[=:]\\\\s*[\"\\']?)(.*)$', 1)"
        hexed = self.put(x, self.long_run(f"lower({x})", HEX, "'secret'"), "[0-9A-Fa-f]")
        other = _let(self.letters(x, "'secret'"), y, self.digits(y, "'secret'"))
        value = f"if({x} rlike '^([0-9a-f]+|[0-9A-F]+)$', {hexed}, {other})"
        return _let(head, h, f"concat({h}, {_let(f'substr({m}, length({h}) + 1)', x, value)})")

    def ip(self, m: str) -> str:
        """A dotted quad of octets; anything else stays."""
        o, p = self.name(), self.name()
        moved = self.following(f"{o}[0] * 256 + {o}[1]", f"{o}[2] * 256 + {o}[3]", "65536L", "65536L", "'ip'")
        shown = f"concat_ws('.', {p}.a div 256, {p}.a % 256, {p}.b div 256, {p}.b % 256)"
        octets = f"transform(split({m}, '[.]'), x -> cast(x as int))"
        return _let(octets, o, f"if(array_max({o}) > 255, {m}, {_let(moved, p, shown)})")

    def date(self, m: str) -> str:
        """A day of the calendar, in the same way of writing; anything else stays."""
        d, p, q = self.name(), self.name(), self.name()
        iso = f"{m} rlike '^[0-9]{{4}}-'"
        day = (
            f"if({iso}, try_cast({m} as date), "
            f"try_cast(concat(substr({m}, 7, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)) as date))"
        )
        index = f"datediff({day}, date'{FIRST_DAY}')"
        k = f"{DAY_PARTS}L"
        moved = self.following(f"{d} div {k}", f"{d} % {k}", k, k, "'date'")
        new = f"date_add(date'{FIRST_DAY}', cast({p}.a * {k} + {p}.b as int))"
        shown = (
            f"if({iso}, cast({q} as string), if({m} rlike '/', date_format({q}, 'dd/MM/yyyy'), date_format({q}, 'dd.MM.yyyy')))"
        )
        fits = f"coalesce({d} >= 0 and {d} < {k} * {k}, false)"
        return _let(index, d, f"if({fits}, {_let(moved, p, _let(new, q, shown))}, {m})")

    def phone(self, m: str) -> str:
        """All digits but those of a country code that is set apart."""
        c = self.name()
        code = f"regexp_extract({m}, '^([+][0-9]{{1,3}}(?=[ .(-])|[+])?', 1)"
        return _let(code, c, f"concat({c}, {self.digits(f'substr({m}, length({c}) + 1)', quoted('phone'))})")

    def luhn(self, digits: str) -> str:
        """Sum of a number whose last digit is not a doubled one."""
        s, c, d = self.name(), self.name(), self.name()
        value = f"cast({c} as int) * (1 + {s}.k % 2)"
        return (
            f"aggregate(filter(split(reverse({digits}), ''), {d} -> {d} != ''), named_struct('n', 0, 'k', 0), "
            f"({s}, {c}) -> named_struct('n', {s}.n + cast(({value}) div 10 as int) + ({value}) % 10, 'k', {s}.k + 1), {s} -> {s}.n)"
        )

    def card(self, m: str) -> str:
        """A number with a right check digit, as another one; anything else stays."""
        d, b = self.name(), self.name()
        plain = f"regexp_replace({m}, '[^0-9]', '')"
        body = self.run(f"substr({d}, 1, length({d}) - 1)", DIGITS, "'card'")
        zero = f"concat({b}, '0')"
        whole = f"concat({b}, cast(pmod(-cast({self.luhn(zero)} as int), 10) as string))"
        return _let(plain, d, f"if({self.luhn(d)} % 10 != 0, {m}, {self.put(m, _let(body, b, whole), '[0-9]')})")

    def ssn(self, m: str) -> str:
        return self.digits(m, "'ssn'")

    def value(self, m: str) -> str:
        """A pseudonym of a match, by its kind."""
        return (
            f"case {kind_of(m)} when 'email' then {self.email(m)} when 'secret' then {self.secret(m)} "
            f"when 'ip' then {self.ip(m)} when 'date' then {self.date(m)} when 'ssn' then {self.ssn(m)} "
            f"when 'card' then {self.card(m)} else {self.phone(m)} end"
        )


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(m: str) -> str:
    """The kind of a match."""
    return (
        f"case when {m} rlike '^(?i:token|passw|secret|api)[^@]*[=:]' then 'secret' when contains({m}, '@') then 'email' "
        f"when {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then 'ip' "
        f"when {m} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}([/.])[0-9]{{2}}[/.][0-9]{{4}})$' then 'date' "
        f"when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn' "
        f"when {m} rlike '^[0-9]' and length(regexp_replace({m}, '[^0-9]', '')) >= 13 then 'card' else 'phone' end"
    )


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with private values in ``text_col`` replaced by their
    pseudonyms, and ``pii_kinds``: the kind of each value that changed, in text order
    (it replaces a column of that name).

    Emails (local parts), secrets after words like ``token =``, IPv4 addresses, dates,
    social security, phone and card numbers are found. Numbers that fail their check
    (Luhn, octets, calendar) stay as they are, like all other text. Null texts stay
    null with no kinds; repeated rows stay repeated.
    """
    p = Permuter(key)
    pattern = quoted("|".join(f"(?:{x})" for x in PATTERNS.values()))
    pairs = f"transform(regexp_extract_all(text, {pattern}, 0), m -> named_struct('old', m, 'new', {p.value('m')}))"
    joined = "array_join(zip_with(between, pairs, (b, x) -> concat(b, coalesce(x.new, ''))), '')"
    kinds = f"transform(filter(pairs, x -> x.old != x.new), x -> {kind_of('x.old')})"
    private = F.col("private")
    d = docs.select(whole_row(docs, ("pii_kinds",)), F.col(f"`{text_col}`").alias("text"))
    d = d.withColumn("private", F.coalesce(F.expr(f"text rlike {pattern}"), F.lit(False)))
    d = d.withColumn("pairs", F.when(private, F.expr(pairs)))
    d = d.withColumn("between", F.when(private, F.expr(f"split(text, {pattern}, -1)")))
    new_text = F.when(private, F.expr(joined)).otherwise(F.col("text"))
    kept = [(new_text if c == text_col else F.col(f"_all.`{c}`")).alias(c) for c in docs.columns if c != "pii_kinds"]
    return d.select(*kept, F.coalesce(F.when(private, F.expr(kinds)), F.array().cast("array<string>")).alias("pii_kinds"))
