"""Header clean-up and short text fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterloom.functions import dates
from letterloom.functions.patterns import CHAT_DOMAIN


def lit_map(entries: dict[str, str]) -> Column:
    """A dictionary as a literal map column."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def either(*values) -> Column:
    """The first value that is neither NULL nor empty, else an empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


# Every character that counts as white space, as a trim set and as a pattern.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
SPACE = "[" + r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + "]"
# Runs of it but for a lone blank, which stays; what is printed in ASCII is ruled out first.
LOOSE = r"[\x00-\x20\x7f-\uffff&&" + f"{SPACE}](?:{SPACE}+|(?<! ))"
ADDRESSES = ("from", "sender", "to", "cc", "bcc")


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(SPACES))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, LOOSE, " "))


def bare_address(text: Column) -> Column:
    """The last non-empty ``<...>``, else the whole text."""
    return strip(F.regexp_replace(text, r"(?s)^.*<([^>]+)>.*$", "$1"))


def lower_domain(bare: Column) -> Column:
    parts = F.split(bare, "@")
    return F.when(
        F.size(parts) == 2, F.concat(parts[0], F.lit("@"), F.lower(parts[1]))).otherwise(bare)


def address(text: Column) -> Column:
    """The last non-empty ``<...>``, else the whole text, with the domain in lower case."""
    return once(bare_address(text), lower_domain)


def subject(text: Column) -> Column:
    """Fold a pile of reply and forward marks into the one that came first."""
    marks = r"\s*:\s*(?:(?:Re|Fwd?)\s*:\s*)*"
    text = F.regexp_replace(text, f"(?i)^Fwd?{marks}", "Fwd: ")
    return F.regexp_replace(text, f"(?i)^Re{marks}", "Re: ")


def header(name: str, value: Column) -> Column:
    """Clean one header value by the rule its name calls for."""
    name = name.strip().lower()
    if name == "date":
        return F.when(value.rlike(dates.CLEAN), value).otherwise(once(collapse_spaces(value), dates.to_iso))
    value = collapse_spaces(value)
    if name in ADDRESSES:
        return address(value)
    return subject(value) if name == "subject" else value


def clean_headers(df, names=("sender", "to", "cc", "subject", "date")):
    """Clean the header columns that ``df`` has.

    Addresses take two projections instead of ``once``, whose value is not compiled.
    """
    there = [n for n in names if n in df.columns]
    people = [n for n in there if n in ADDRESSES]
    df = df.withColumns({n: bare_address(collapse_spaces(F.col(n))) if n in people else header(n, F.col(n)) for n in there})
    return df.withColumns({n: lower_domain(F.col(n)) for n in people}) if people else df


def _cut(text: Column, limit: int) -> Column:
    def short(text):
        head = F.rtrim(F.substring(text, 1, 77), F.lit(SPACES))
        return F.when(F.length(text) > limit, F.concat(head, F.lit("..."))).otherwise(text)

    return once(text, short)


def snippet_field(text: Column) -> Column:
    """A snippet on one line, safe inside a pipe-delimited row."""
    return _cut(F.translate(F.regexp_replace(strip(text), r"[\r\n]+", " "), "|", "/"), 80)


def flat_body(text: Column) -> Column:
    """A whole body on one short line, for transcripts."""
    return _cut(F.translate(collapse_spaces(text), "|", "/"), 77)


def human_size(bytes_: Column) -> Column:
    """``500b``, ``2kb``, ``1mb``: decimal thresholds, binary units, half-even rounding."""
    kb = F.greatest(F.bround(bytes_ / F.lit(1024.0)), F.lit(1.0)).cast("bigint")
    mb = F.greatest(F.bround(bytes_ / F.lit(1048576.0)), F.lit(1.0)).cast("bigint")
    return (
        F.when(F.coalesce(bytes_, F.lit(0)) == 0, F.lit("0b"))
        .when(bytes_ < 1000, F.concat(bytes_.cast("string"), F.lit("b")))
        .when(bytes_ < 1_000_000, F.concat(kb.cast("string"), F.lit("kb")))
        .otherwise(F.concat(mb.cast("string"), F.lit("mb")))
    )


def text_size(text: Column) -> Column:
    return human_size(F.octet_length(text))


def message_size(size: Column, body: Column, snippet: Column) -> Column:
    """The stored size where there is one, else that of the body, else of the snippet."""
    return F.coalesce(size, text_size(either(body, snippet)))


def source_of(source: Column, id_: Column) -> Column:
    """The stored source, else the prefix of the id."""
    prefix = F.when(F.instr(id_, ":") > 0, F.substring_index(id_, ":", 1)).otherwise("")
    return F.coalesce(source, prefix)


def participants(names: Column, total: Column) -> Column:
    """The first three names and how many more there are."""
    more = total - F.lit(3)
    joined = F.array_join(F.slice(names, 1, 3), ",")
    return F.when(more > 0, F.concat(joined, F.lit("+"), more.cast("string"))).otherwise(joined)


def phone_to_chat(phone: Column) -> Column:
    """An international phone number as a chat identifier; NULL where it is not clearly one."""
    text = strip(phone)
    is_uri = F.lower(text).startswith("tel:")
    rest = F.when(is_uri, F.substr(text, F.lit(5))).otherwise(text)
    number = strip(F.substring_index(rest, ";", 1))
    digits = F.regexp_replace(number, r"(?U)\D", "")
    plus = number.startswith("+")
    zeros = ~plus & digits.startswith("00")
    digits = F.when(zeros, F.substr(digits, F.lit(3))).otherwise(digits)
    extension = (is_uri & rest.rlike(r"(?iU);\s*(?:ext|extension)\s*=")) | number.rlike(
        r"(?iU)\bext\.?\b|\bextension\b|x\d+\s*$")
    return F.when(
        ~extension & (plus | zeros) & F.length(digits).between(7, 15),
        F.concat(digits, F.lit(CHAT_DOMAIN)),
    )


def strip_mailto(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)^mailto:", "")


def strip_source(id_: Column, prefix: Column) -> Column:
    """The provider's own id."""
    mark = F.concat(prefix, F.lit(":"))
    return F.when(F.startswith(id_, mark), F.substring(id_, F.length(mark) + 1, F.length(id_))).otherwise(id_)


def path_id(id_: Column) -> Column:
    """An id that is safe as a file name."""
    return F.regexp_replace(id_, r"[^A-Za-z0-9._-]", "_")


def xml_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attr(text: Column) -> Column:
    """A quoted attribute value; the quote sign follows from the content."""
    value = xml_text(text)
    for char, entity in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    double, single = F.lit('"'), F.lit("'")
    return (
        F.when(~value.contains('"'), F.concat(double, value, double))
        .when(~value.contains("'"), F.concat(single, value, single))
        .otherwise(F.concat(double, F.replace(value, double, F.lit("&quot;")), double))
    )


def mailbox_identity(provider: Column, email: Column, mailbox: Column,
                     client_id: Column, tenant_id: Column) -> Column:
    """Which account a source points at; empty for sources that are not cached."""
    provider = F.lower(F.coalesce(provider, F.lit("")))
    app = F.concat(F.coalesce(client_id, F.lit("")), F.lit("/"), F.coalesce(tenant_id, F.lit("common")))
    gmail = F.when(either(email) == "", F.lit("")).otherwise(F.concat(F.lit("gmail:"), email))
    return (
        F.when(provider == "gmail", gmail)
        .when(provider == "o365", F.concat(F.lit("o365:"), either(mailbox, email, app)))
        .otherwise(F.lit(""))
    )
