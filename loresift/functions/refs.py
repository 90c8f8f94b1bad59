"""References (``path`` or ``path#slug``) and stable identifiers as Column expressions, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def file_of(ref: Column) -> Column:
    """The path before the first ``#``; a null reference gives ''."""
    return F.substring_index(F.coalesce(ref, F.lit("")), "#", 1)


def sql_file_of(ref: str) -> str:
    return f"split_part(coalesce({ref}, ''), '#', 1)"


def basename(ref: Column) -> Column:
    """The stem of the last path part: its name without the last suffix, if something stands before that."""
    last = F.regexp_extract(F.coalesce(ref, F.lit("")), "([^/]*)/*$", 1)
    return F.when(last.isin(".", ""), "").otherwise(F.regexp_replace(last, "(?<=.)\\.[^.]+$", ""))


def sql_basename(ref: str) -> str:
    last = f"regexp_extract(coalesce({ref}, ''), '([^/]*)/*$', 1)"
    return f"(case when {last} in ('.', '') then '' else regexp_replace({last}, '^(.+)\\.[^.]+$', '\\1') end)"


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot; none gives ''."""
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def stable_id(source: Column, ref: Column) -> Column:
    """26 base-32 digits of the first 128 bits of sha-256 over ``source::ref``."""
    digest = F.substring(F.sha2(F.concat(source, F.lit("::"), ref), 256), 1, 32)
    # two zero bits, then 128: as 130 bits they are 26 groups of five
    bits = F.concat(F.lit("00"), *[F.lpad(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(4)])
    digits = [F.substring(F.lit(CROCKFORD), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(26)]
    return F.concat(*digits)


def sql_stable_id(source: str, ref: str) -> str:
    bits = "'00' || " + " || ".join(f"lpad(bin(('0x' || substr(sha256({source} || '::' || {ref}), {1 + 8 * i}, 8))::bigint), 32, '0')" for i in range(4))
    return f"list_aggregate(list_transform(range(26), lambda i: substr('{CROCKFORD}', list_aggregate(list_transform(range(5), lambda j: substr({bits}, 1 + 5 * i + j, 1)::int * (16 >> j)), 'sum')::int + 1, 1)), 'string_agg', '')"


def size_label(n: Column) -> Column:
    """Bytes as B, KB or MB."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1024 * 1024, F.concat((n / 1024).cast("bigint").cast("string"), F.lit("KB"))).otherwise(F.format_string("%.1fMB", n / (1024 * 1024)))


def ref_label(ref: Column, lines: Column) -> Column:
    """``ref:a-b`` where a pair of lines is known."""
    return F.when(F.size(lines) == 2, F.concat(ref, F.lit(":"), lines[0].cast("string"), F.lit("-"), lines[1].cast("string"))).otherwise(ref)
