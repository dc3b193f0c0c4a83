"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

One pattern finds candidates: e-mail addresses, IPv4 and IPv6 addresses, phone,
card and social security numbers, bank account numbers (IBAN), dates, and secret
keys. Ten digits alone are a phone number only where a word before them says so.
Each is validated by its own rule (Luhn, modulo 97, calendar, octet range, the
numbers that a social security or phone number may have) and, if valid, replaced
by a keyed permutation of its value within its format, which is valid again:

* strings of letters and digits by a Feistel network on the two halves of their
  letters and digits, whose round function shifts every character within its
  class (digit, small, capital); length, punctuation and case stay;
* card numbers keep their first digit (34 and 37 of fifteen both), permute the middle, and get a new check
  digit; IBANs get new check digits;
* addresses by a Feistel network on two 16-bit halves, those of eight groups by one
  on all hexadecimal digits behind the first group; social security numbers by
  one on 898 x 99 areas and groups and 9,999 serials; phone numbers of ten digits
  by one on 800 areas, 1,000 exchanges and 10,000 lines, others digit by digit
  behind their country code (7 to 15 digits together);
* dates by one on the 250 x 292 days from 1900-01-01 on, all other dates of the
  years 1 to 9999 by one on the remaining 1,331 x 2,689 days.

A permutation never maps two values to one, and equal values (in any of a
format's spellings) stay linked across documents. What is not valid stays.

Nulls and limits: a null text stays null; an empty text stays empty; any number
of findings in a text of any length is replaced; repeated rows get equal
results; a null ``doc_id`` is kept; where two kinds could begin at one place the
first in the order of ``KINDS`` is taken; all other columns pass through unread,
whatever their names (``into`` names the new one, which must not be there yet);
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import documents, free_names, let, refuse_clash

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: The months' names and their short forms.
_MONTH = r"(?i:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_NTH = r"(?:st|nd|rd|th)?"
#: What begins global, local and link addresses of eight groups, and a group.
_FIRST, _GROUP = r"(?:[23][0-9A-Fa-f]{3}|[fF][cCdDeE][0-9A-Fa-f]{2})", r"[0-9A-Fa-f]{1,4}"
_TOKEN = "[A-Za-z0-9_+/-]"
#: What names a phone number, and a secret. Look-behinds over words are dear, so cheap looks at the neighbours come first.
_PHONE_NAMED = r"(?=0\d{9,11}|[2-9]\d{9})(?<=\b(?i:tel|phone|telephone|mobile|cell|fax|call|whatsapp)[.:]? {0,2})(?:0\d{9,11}|[2-9]\d{9})(?!\w|[-.]\d)"
_SECRET_NAME = "(?i:token|secret|key|password|passwd|pwd)"
#: Patterns of the kinds, tried in this order. Repetitions without a bound are possessive and of one class, or of groups that
#: begin with a mark of their own, so they are loops: no text makes matching go deep, or go back over what it has read.
KINDS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}][\p{L}\p{N}-]*+(?:\.[\p{L}\p{N}][\p{L}\p{N}-]*+)++",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ipv6": rf"(?<![\w:.]){_FIRST}(?:(?::{_GROUP}){{7}}|(?::{_GROUP}){{1,5}}::(?:{_GROUP}(?::{_GROUP}){{0,4}})?|::{_GROUP}(?::{_GROUP}){{0,5}})(?![\w:]|\.\d)",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}(?:-(?!00)\d{2}-|(?<!\d \d{3}) (?!00)\d{2} (?!\d{4} \d))(?!0000)\d{4}(?![\w-])",
    "date": rf"(?<![\w.-])(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}(?:[./]\d{{1,2}}[./]|-\d{{1,2}}-)\d{{4}}|{_MONTH}\.? \d{{1,2}}{_NTH},? \d{{4}}|\d{{1,2}}{_NTH} {_MONTH}\.?,? \d{{4}})(?!\w|[-.]\d)",
    "phone": r"(?<![\w+.-])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|(?<!\d )[2-9]\d{2}[ .-]\d{3}[ .-]\d{4}(?! \d)|(?<!\d )0\d{2,5}[ /-]\d{5,8}(?! \d))(?!\w|-\d)"
    # What is named a phone: digits alone.
    rf"|{_PHONE_NAMED}",
    "card": r"(?<!\w)(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|3[47]\d{2}(?: \d{6} |-\d{6}-)\d{5}|\d{13,19})(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "secret": r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?<!\w)(?:[spr]k_(?:live|test)_|gh[pousr]_|xox[abprs]-)[A-Za-z0-9_-]{8,}+"
    r"|(?<![\w.-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
    # What is named a secret: in quotes, or with letters and digits both.
    rf"|(?<=[=: \"'])(?={_TOKEN}{{8}})(?<=[=:] ?[\"']?)(?<={_SECRET_NAME} ?[=:] ?[\"']?)(?:{_TOKEN}{{16,}}+(?=[\"'])|(?=[A-Za-z_+/-]*+\d)(?=[\d_+/-]*+[A-Za-z]){_TOKEN}{{8,}}+)",
}
#: Every finding begins with one of these behind no letter or digit, but for a phone number that stands right behind its name.
ANY = rf"(?<!\w)(?=[\p{{L}}\p{{N}}_+(/-])(?:{'|'.join(f'(?:{p})' for p in KINDS.values())})|(?<=[A-Za-z]){_PHONE_NAMED}"
#: A text without these holds nothing to find.
HINT = (
    rf"@|\d[\d .()/-]{{4,}}\d|[=:](?<={_SECRET_NAME} ?[=:])"
    rf"|(?<!\w)(?:AKIA|ASIA|[spr]k_(?:live|test)_|gh[pousr]_|xox[abprs]-|eyJ|{_FIRST}:[0-9A-Fa-f:]|{_MONTH}\.?,? \d{{1,4}})"
)
#: Beginnings of keys that say whose they are.
PREFIX = r"^(?:AKIA|ASIA|[spr]k_(?:live|test)_|gh[pousr]_|xox[abprs]-|eyJ)"
ROUNDS = 6
#: Days from 1900-01-01 on that are permuted among themselves, and the other days of the years 1 to 9999.
DAY_SIDES, FAR_SIDES = (250, 292), (1331, 2689)
#: Days from 0001-01-01 to 1900-01-01.
BEFORE_1900 = 693595


def _column(key: Column | str) -> Column:
    """A key as text becomes part of the plan, where plans and logs show it; ``pseudonymise`` hands over a column."""
    return F.lit(key) if isinstance(key, str) else key


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _stream(key: Column, tweak: str, number: Column, value: Column) -> Column:
    """64 hexadecimal digits that depend on the key, the round and the other half."""
    return F.sha2(F.concat(key, F.lit(f"|{tweak}|"), number.cast("string"), F.lit("|"), value.cast("string")).cast("binary"), 256)


def _shift(text: Column, stream: Column, small: Column) -> Column:
    """Every letter or digit moved within its class by the stream's next number; ``small`` letters count in the class of small ones."""

    def all_of(st: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            step, code = _number(F.substring(st, (i % 32) * 2 + 1, F.lit(2))), F.ascii(c)
            within = lambda first, size: F.char(F.lit(first) + (code - first + step) % size)
            return F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, small)).when(code.between(65, 90), within(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    return let(stream, all_of)


def permute_text(text: Column, key: Column | str, tweak: str, small: Column | None = None) -> Column:
    """Feistel network over a string of letters and digits; one character alone is shifted by a constant."""
    key = _column(key)
    small = F.lit(26) if small is None else small
    return let(text, lambda t: _network(t, key, tweak, small))


def _network(text: Column, key: Column, tweak: str, small: Column) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    # Each round shifts one half by the other and swaps; the count of rounds is even, so the halves end in place.
    return F.aggregate(rounds, start, lambda s, r: F.struct(s["b"].alias("a"), _shift(s["a"], _stream(key, tweak, r, F.lower(s["b"])), small).alias("b")), lambda s: F.concat(s["a"], s["b"]))


def permute_pair(left: Column, right: Column, sides: tuple[int, int], key: Column | str, tweak: str) -> Column:
    """Feistel network over a pair of numbers below ``sides``: struct(l, r)."""
    key = _column(key)

    def step(s: Column, r: Column) -> Column:
        move = lambda other, size: (_number(F.substring(_stream(key, tweak, r, other), 1, 12)) % size)
        l, x = s["l"], s["r"]
        odd = r % 2 == 1
        return F.struct(F.when(odd, (l + move(x, sides[0])) % sides[0]).otherwise(l).alias("l"), F.when(odd, x).otherwise((x + move(l, sides[1])) % sides[1]).alias("r"))

    start = F.struct(F.coalesce(left.cast("long"), F.lit(0).cast("long")).alias("l"), F.coalesce(right.cast("long"), F.lit(0).cast("long")).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _fill(shape: Column, letters: Column) -> Column:
    """``shape`` with its letters and digits replaced, in order, by those of ``letters``; by sorting places, as either may be long."""

    def all_of(both: Column) -> Column:
        chars, new = both["chars"], both["new"]
        places = F.sequence(F.lit(0), F.size(chars) - 1)
        own = lambda i: F.get(chars, i).rlike("^[A-Za-z0-9]$")
        moved = F.transform(F.filter(places, own), lambda i, k: F.struct(i.alias("i"), F.get(new, k).alias("c")))
        kept = F.transform(F.filter(places, lambda i: ~own(i)), lambda i: F.struct(i.alias("i"), F.get(chars, i).alias("c")))
        return F.array_join(F.transform(F.sort_array(F.concat(moved, kept)), lambda x: x["c"]), "")

    return let(F.struct(F.split(shape, "").alias("chars"), F.split(letters, "").alias("new")), all_of)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, doubling every second from the right, the last not doubled."""

    def one(total: Column, v: Column) -> Column:
        d = v["d"].cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(v["i"] % 2 == 1, twice).otherwise(d)

    numbered = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), one)


def _card(value: Column, key: Column) -> Column:
    d = _bare(value)
    # What says whose card it is stays: a digit, or two where the first alone would not.
    kept = F.when(d.rlike("^3[47][0-9]{13}$"), 2).otherwise(1)
    inner = permute_text(F.substring(d, kept + 1, F.length(d) - kept - 1), key, "card")
    check = lambda body: ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    new = let(F.concat(F.substring(d, F.lit(1), kept), inner), lambda body: F.concat(body, check(body)))
    return F.when(luhn_sum(d) % 10 == 0, _fill(value, new)).otherwise(value)


def _mod97(text: Column) -> Column:
    """Remainder of the number that a string of digits and capitals stands for."""

    def one(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), one)


def _iban(value: Column, key: Column) -> Column:
    d = _bare(value)
    country, account = F.substring(d, 1, 2), F.substring(d, F.lit(5), F.length(d))
    check = lambda new: F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    whole = let(permute_text(account, key, "iban"), lambda new: F.concat(country, check(new), new))
    valid = _mod97(F.concat(account, F.substring(d, 1, 4))) == 1
    return F.when(valid, _fill(value, whole)).otherwise(value)


def _ip(value: Column, key: Column) -> Column:
    o = F.split(value, r"\.")
    p = permute_pair(o[0].cast("int") * 256 + o[1].cast("int"), o[2].cast("int") * 256 + o[3].cast("int"), (65536, 65536), key, "ip")
    return let(p, lambda x: F.concat_ws(".", *(f(x[side]).cast("string") for side in ("l", "r") for f in (lambda y: F.floor(y / 256), lambda y: y % 256))))


def _ipv6(value: Column, key: Column) -> Column:
    """The first of the eight groups stays, the others are permuted; written out whole, so that all spellings of one address meet."""
    part = F.split(F.lower(value), "::")
    groups = lambda k: F.filter(F.split(F.coalesce(F.get(part, F.lit(k)), F.lit("")), ":"), lambda g: g != "")

    def whole(both: Column) -> Column:
        missing = 8 - F.size(both["l"]) - F.size(both["r"])
        full = F.concat(both["l"], F.array_repeat(F.lit("0"), missing), both["r"])
        digits = F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")
        written = lambda d: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(d, i * 4 + 1, F.lit(4))), ":")
        new = let(F.concat(F.substring(digits, 1, 4), permute_text(F.substring(digits, 5, 28), key, "ipv6", F.lit(6))), written)
        return F.when((missing == 0) | ((missing > 0) & F.contains(value, F.lit("::"))), new)

    return F.coalesce(let(F.struct(groups(0).alias("l"), groups(1).alias("r")), whole), value)


def _month_of(name: Column) -> Column:
    """The number of a month's name or short form, as text."""
    first = F.lower(F.substring(name, 1, 3))
    out = F.lit(None).cast("string")
    for number, short in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1):
        out = F.when(first == short, F.lit(str(number))).otherwise(out)
    return out


def _in_words(value: Column, name: Column, new: Column) -> Column:
    """A date with a month's name, in the value's order, with its short or long form, its comma and its ending of the day."""
    day = F.day(new)
    ending = F.when(day.between(11, 13), F.lit("th")).otherwise(F.coalesce(F.get(F.array(*map(F.lit, ("th", "st", "nd", "rd"))), day % 10), F.lit("th")))
    d = F.concat(day.cast("string"), F.when(value.rlike("[0-9](?:st|nd|rd|th)"), ending).otherwise(F.lit("")))
    m = F.when(F.length(name) > 4, F.date_format(new, "MMMM")).otherwise(F.date_format(new, "MMM"))
    comma = F.when(F.contains(value, F.lit(",")), F.lit(",")).otherwise(F.lit(""))
    both = F.when(value.rlike("^[A-Za-z]"), F.concat(m, F.lit(" "), d)).otherwise(F.concat(d, F.lit(" "), m))
    return F.concat(both, comma, F.lit(" "), F.lpad(F.year(new).cast("string"), 4, "0"))


def _date(value: Column, key: Column) -> Column:
    """Year first, or day and month in either order (month first where both could be, unless points part them), or a month's name."""
    name = F.regexp_extract(value, _MONTH, 0)
    named = name != ""
    numbers = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    part = F.split(value, "[-./]")
    first, second = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    iso = F.length(first) == 4
    month_first = ~named & ~iso & value.rlike("[/-]") & (F.length(first) <= 2) & (F.try_to_number(first, F.lit("99")) <= 12)
    year = F.when(named, F.get(numbers, F.lit(1))).when(iso, first).otherwise(F.get(part, F.lit(2)))
    month = F.when(named, _month_of(name)).when(iso | ~month_first, second).otherwise(first)
    day = F.when(named, F.get(numbers, F.lit(0))).when(iso, F.get(part, F.lit(2))).when(month_first, second).otherwise(first)
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    mark = F.when(F.contains(value, F.lit("/")), F.lit("/")).when(F.contains(value, F.lit("-")), F.lit("-")).otherwise(F.lit("."))
    # Two digits where the value has them or where the new number needs them.
    two = lambda x, like: F.when(F.length(like) == 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))

    def written(new: Column) -> Column:
        x, y = F.when(month_first, F.month(new)).otherwise(F.day(new)), F.when(month_first, F.day(new)).otherwise(F.month(new))
        return F.when(named, _in_words(value, name, new)).when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(two(x, first), mark, two(y, second), mark, F.lpad(F.year(new).cast("string"), 4, "0")))

    def moved(days: Column) -> Column:
        """The new date of a number of days since 0001-01-01."""
        near = DAY_SIDES[0] * DAY_SIDES[1]
        at = days - BEFORE_1900
        inner = permute_pair(F.floor(at / DAY_SIDES[1]), F.pmod(at, F.lit(DAY_SIDES[1])), DAY_SIDES, key, "date")
        rest = F.when(days < BEFORE_1900, days).otherwise(days - near)
        outer = permute_pair(F.floor(rest / FAR_SIDES[1]), F.pmod(rest, F.lit(FAR_SIDES[1])), FAR_SIDES, key, "far date")
        later = lambda x: F.when(x < BEFORE_1900, x).otherwise(x + near)
        number = F.when((at >= 0) & (at < near), let(inner, lambda x: x["l"] * DAY_SIDES[1] + x["r"] + BEFORE_1900)).otherwise(let(let(outer, lambda x: x["l"] * FAR_SIDES[1] + x["r"]), later))
        return F.date_add(F.lit("0001-01-01").cast("date"), number.cast("int"))

    days = F.datediff(date, F.lit("0001-01-01").cast("date"))
    out = let(days, lambda n: F.when((n >= 0) & (n < BEFORE_1900 + DAY_SIDES[0] * DAY_SIDES[1] + (FAR_SIDES[0] * FAR_SIDES[1] - BEFORE_1900)), let(moved(n), written)))
    return F.coalesce(out, value)


def _ssn(value: Column, key: Column) -> Column:
    """Areas 001 to 899 but 666, groups and serials from 1 on."""
    part = F.split(value, "[- ]")
    number = lambda k: F.get(part, F.lit(k)).cast("int")
    area = F.when(number(0) < 666, number(0) - 1).otherwise(number(0) - 2)
    p = permute_pair(area * 99 + number(1) - 1, number(2) - 1, (898 * 99, 9999), key, "ssn")
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    wide = lambda x: F.when(x < 665, x + 1).otherwise(x + 2)
    mark = F.substring(value, 4, 1)
    return let(p, lambda x: F.concat(padded(wide(F.floor(x["l"] / 99)), 3), mark, padded(x["l"] % 99 + 1, 2), mark, padded(x["r"] + 1, 4)))


def _phone(value: Column, key: Column) -> Column:
    """The country code stays (two digits, where nothing parts it from the rest), or the zero of a number within a country; what follows is permuted."""
    code = F.regexp_extract(value, r"^(?:\+1(?=[ .-]?\(?[2-9])|\+\d{1,3}(?=[ .(-])|\+\d{2}(?=\d)|0(?=\d))?", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    digits = _bare(rest)
    ten = digits.rlike(r"^[2-9]\d{9}$") & code.isin("", "+1")
    number = lambda a, n: F.substring(digits, a, n).cast("int")
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    pair = permute_pair((number(1, 3) - 200) * 1000 + number(4, 3), number(7, 4), (800_000, 10_000), key, "phone")
    local = let(pair, lambda x: F.concat((F.floor(x["l"] / 1000) + 200).cast("string"), padded(x["l"] % 1000, 3), padded(x["r"], 4)))
    new = F.when(ten, local).otherwise(permute_text(digits, key, "phone"))
    size = F.length(_bare(value))
    # Ten digits without a code must be such a number, unless brackets mark the area.
    return F.when(size.between(7, 15) & (ten | (code != "") | F.contains(value, F.lit("("))), F.concat(code, _fill(rest, new))).otherwise(value)


def _token(value: Column, key: Column) -> Column:
    """Secrets: a known prefix stays, and hexadecimal strings (of small letters) stay hexadecimal."""
    fixed = F.regexp_extract(value, PREFIX, 0)
    rest = F.substring(value, F.length(fixed) + 1, F.length(value))
    small = F.when(value.rlike("^[0-9a-f]+$"), 6).otherwise(26)
    return F.concat(fixed, _fill(rest, permute_text(_bare(rest), key, "secret", small)))


def _email(value: Column, key: Column) -> Column:
    """Name and domain are permuted, the last label stays, and so do letters and digits other than A-Z, a-z and 0-9."""
    last = F.regexp_extract(value, r"\.[^.]*$", 0)
    rest = F.substring(value, F.lit(1), F.length(value) - F.length(last))
    return F.concat(_fill(rest, permute_text(_bare(rest), key, "email")), last)


def pseudonym(value: Column, kind: Column, key: Column | str) -> Column:
    """The pseudonym of a finding; a finding that is not valid is its own."""
    key = _column(key)
    by = {"email": _email, "ip": _ip, "ipv6": _ipv6, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card, "iban": _iban, "secret": _token}
    out = F.when(F.lit(False), value)
    for name, rule in by.items():
        out = out.when(kind == name, rule(value, key))
    return out.otherwise(value)


def kind_of(value: Column) -> Column:
    out = F.when(F.contains(value, F.lit("@")), F.lit("email"))
    for name in ("ip", "ipv6", "ssn", "date", "phone", "card", "iban"):
        out = out.when(value.rlike(f"^(?:{KINDS[name]})$"), F.lit(name))
    # A number that its neighbourhood names a phone does not look like one alone.
    return out.when(value.rlike("^[0-9]{10,12}$"), F.lit("phone")).otherwise(F.lit("secret"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with ``text`` rewritten, plus ``into``: array of (kind, value, pseudonym) of what was replaced, in order.

    The key is a scalar subquery over a row of its own, so that neither plans nor event logs show it.
    """
    refuse_clash(docs.columns, into)
    secret = docs.sparkSession.createDataFrame([(key,)], "value string").scalar()
    t = F.col(f"`{text}`")
    found, kinds, named, held = free_names([*docs.columns, into], "found", "kinds", "named", "held")
    all_ = F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    each = F.transform(found, lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value")))
    new = F.transform(kinds, lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), pseudonym(s["value"], s["kind"], F.col(held)).alias("pseudonym")))
    between = F.split(t, ANY, -1)
    joined = F.array_join(F.flatten(F.transform(between, lambda x, i: F.array(x, F.coalesce(F.get(F.col(named), i)["pseudonym"], F.lit(""))))), "")
    staged = docs.withColumn(held, secret).withColumn(found, all_).withColumn(kinds, each).withColumn(named, new)
    out = staged.withColumn(text, F.when(F.size(found) > 0, joined).otherwise(t)).withColumn(into, F.filter(named, lambda s: s["value"] != s["pseudonym"]))
    return out.drop(found, kinds, named, held)


#: The key of the registered query; a deployment passes its own.
QUERY_KEY = "registered-query"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), QUERY_KEY)
    return done.select("doc_id", "text", F.size("pii").alias("n_replaced"), F.array_sort(F.array_distinct("pii.kind")).alias("kinds"))
