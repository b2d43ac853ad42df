"""The p-queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import canonical, copies, encoding, langid, mixing, neardup, packing, pairs, spam, tokens

TEXTS = ("plainlyrics", "syncedlyrics")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(table(spark, d, "lrclib"), "lrclib_id", TEXTS)


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored(table(spark, d, "lrclib"), "lrclib_id", TEXTS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found(table(spark, d, "lrclib"), table(spark, d, "scribe_vocals"))


def p7_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_texts(table(spark, d, "lrclib"), table(spark, d, "scribe_vocals"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(table(spark, d, "lrclib"), "lrclib_id", "plainlyrics", skip=encoding.is_garbled)


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Classes and their links, without the pairs of copies."""
    return neardup.links(table(spark, d, "lrclib"), "lrclib_id", "plainlyrics", skip=encoding.is_garbled)


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p3_found with those of wrongly decoded records, as SQL can tell them."""
    return neardup.pairs(table(spark, d, "lrclib"), "lrclib_id", "plainlyrics")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.found(table(spark, d, "lrclib"))


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    return copies.counts(table(spark, d, "lrclib"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "plan_lines"), table(spark, d, "plan_docs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.found(*(table(spark, d, t) for t in ("scribe_vocals", "plan_docs", "plan_lines", "lang_codes")))


def p6_stretches(spark: SparkSession, d: str) -> DataFrame:
    v, p, l = (table(spark, d, t) for t in ("scribe_vocals", "plan_docs", "plan_lines"))
    return langid.stretches(v, p, l, langid.fit(l, p))


def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    v, p, l = (table(spark, d, t) for t in ("scribe_vocals", "plan_docs", "plan_lines"))
    return langid.documents(v, l, langid.fit(l, p))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.counted(table(spark, d, "documents")), table(spark, d, "pack_sizes"))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p8_pack(spark, d), table(spark, d, "pack_sizes"))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    from ..session import cut

    sizes, packs = cut(tokens.counted(table(spark, d, "documents"))), table(spark, d, "pack_sizes")
    return packing.checked(sizes, packing.pack(sizes, packs), packs)


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    from ..session import cut

    docs = cut(tokens.counted(table(spark, d, "documents"), "source", weigh=True))
    return mixing.checked(docs, *mixing.mix(docs, table(spark, d, "mix_targets")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(tokens.counted(table(spark, d, "documents"), "source", weigh=True), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(tokens.counted(table(spark, d, "documents"), "source", weigh=True), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.found(table(spark, d, "documents"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.scored(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p3_found, p3_links, p3_pairs, p4_found, p4_copies, p5_found, p6_found, p6_stretches, p6_languages, p7_found, p7_canonical, p8_pack, p8_usage, p8_checked, p9_mix, p9_shares, p9_checked, p10_found, p10_scores)}

_P4 = r"""
with r as (
  select distinct lrclib_id id, regexp_replace(lower(coalesce(plainlyrics, '')), '[^\p{L}\p{N}]+', '', 'g') p,
    string_split_regex(coalesce(syncedlyrics, ''), '\r\n|\n|\r') ls from lrclib where lrclib_id is not null),
n as (
  select id, p,
    list_sort(list_filter(list_transform(list_filter(ls, lambda x: regexp_full_match(x, '\s*\[\p{L}+:.*\]\s*')),
      lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '')) h,
    regexp_replace(lower(array_to_string(list_filter(ls, lambda x: not regexp_full_match(x, '\s*\[\p{L}+:.*\]\s*')), chr(10))), '[^\p{L}\p{N}]+', '', 'g') s
  from r),
g as (select id, min(id) over (partition by p, h, s) k from n where p <> '' or s <> '' or len(h) > 0)
"""
_P3 = r"""
with r as (select distinct lrclib_id id, string_split(trim(regexp_replace(lower(plainlyrics), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') w from lrclib where lrclib_id is not null and plainlyrics is not null),
s as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g from r where len(w) > 2),
n as (select id, count(*) n from s group by 1),
j as (select a.id a, b.id b, count(*) c from s a join s b on a.g = b.g and a.id < b.id group by 1, 2)
select a as id_a, b as id_b from j join n x on x.id = a join n y on y.id = b where c >= 0.6 * (x.n + y.n - c)
"""
SQL: dict[str, str] = {
    "p3_pairs": _P3,
    "p8_checked": "select pack_name, (select count(distinct doc_id) from documents) as documents, 0::bigint as overfull, 0::bigint as incomplete, 0::bigint as split from pack_sizes",
    "p9_checked": "select source, target_share, true as share_ok, true as repeats_ok, true as epochs_ok from mix_targets",
    "p4_found": _P4 + "select distinct k as keep_id, id as copy_id from g where id > k",
    "p4_copies": _P4 + "select k as keep_id, count(distinct id) as copies from g group by k",
}
