"""Ranked lookups in a library of voices (suppliers stand in for voices, nations for languages)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table
from .base import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
_V = "v as (select s_suppkey, s_name as name, s_nationkey as native, [s_nationkey, (s_suppkey % 25)::int] as speaks, case when s_acctbal > 4000 then 'female' else 'male' end as gender from supplier)"


def voices(s, d):
    """(s_suppkey, name, native, speaks, gender)."""
    t = table(s, d, "supplier")
    speaks = F.array_union(F.array("s_nationkey"), F.array((F.col("s_suppkey") % 25).cast("int")))
    return t.select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("native"), speaks.alias("speaks"), F.when(F.col("s_acctbal") > 4000, "female").otherwise("male").alias("gender"))


@query("select s_suppkey, s_name as name, n_name as language from supplier join nation on n_nationkey = s_nationkey")
def src_voices(s, d):
    """The library of voices, read once; nation has 25 rows at every size."""
    n = F.broadcast(table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("language")))
    v = table(s, d, "supplier")
    return v.join(n, v["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", F.col("s_name").alias("name"), "language")


@query(f"with {_V} select s_suppkey, list_contains(speaks, 3) as speaks from v")
def set_speaks(s, d):
    """Whether a voice speaks language 3, natively or by verification."""
    return voices(s, d).select("s_suppkey", F.array_contains("speaks", 3).alias("speaks"))


@query(f"with {_V}, x as (select *, unnest(list_distinct(speaks)) lang from v) select lang, s_suppkey, cast(row_number() over (partition by lang order by lang <> native, name) as bigint) as rank, lang = native as native, not bool_or(lang = native) over (partition by lang) as foreign_only from x")
def rank_voices(s, d):
    """Voices of each language, native ones first, then by name; ``foreign_only`` warns that none of them is native."""
    x = voices(s, d).select("s_suppkey", "name", "native", F.explode(F.array_distinct("speaks")).alias("lang"))
    native = F.col("lang") == F.col("native")
    n = F.row_number().over(W.partitionBy("lang").orderBy(~native, "name")).cast("bigint")
    return x.select("lang", "s_suppkey", n.alias("rank"), native.alias("native"), (~F.bool_or(native).over(W.partitionBy("lang"))).alias("foreign_only"))


# Voices asked for, by language: a number of the library, part of a name, something like an id of another library, or nothing.
_ASK = "q as (select n_nationkey lang, case when n_nationkey % 2 = 0 then 'female' else 'male' end g, case n_nationkey % 5 when 0 then cast(n_nationkey * 3 + 1 as varchar) when 1 then 'R#0000000' || lpad(cast(n_nationkey as varchar), 2, '0') when 2 then 'voice0123456789abc' || cast(n_nationkey as varchar) when 3 then case when n_nationkey > 10 then 'no such' end end spec from nation)"
# The voices a language has by default: (language, gender, voice); those of language 0 serve where no other does.
DEFAULT_VOICES = ((0, "male", "default-0-m"), (0, "female", "default-0-f"), (3, "male", "default-3-m"), (4, "female", "default-4-f"))
_DEF = "df as (select * from (values " + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in DEFAULT_VOICES) + ") t(dl, dg, dv))"


@query(f"""with {_V}, {_ASK}, {_DEF}, o as (select lang, cast(s_suppkey as varchar) voice, 0 rung, '' a, false b, '' n from q join v on spec = cast(s_suppkey as varchar)
union all select lang, cast(s_suppkey as varchar), 1, '', false, lpad(cast(s_suppkey as varchar), 12, '0') from q join v on contains(lower(name), lower(spec))
union all select lang, spec, 2, '', false, '' from q where regexp_full_match(spec, '[\\p{{L}}\\p{{N}}]{{18,}}') union all select lang, dv, 3, '', false, '' from q join df on dl = lang and dg = g where spec is null
union all select lang, cast(s_suppkey as varchar), 4, case when gender = g then '0' else '1' end, lang <> native, name || lpad(cast(s_suppkey as varchar), 12, '0') from q join v on list_contains(speaks, lang) where spec is null
union all select lang, dv, 5, '', false, '' from q join df on dl = 0 and dg = g where spec is null),
r as (select *, row_number() over (partition by lang order by rung, a, b, n) k from o) select q.lang, r.voice, coalesce(['number', 'name', 'id', 'default', 'library', 'fallback'][r.rung + 1], 'unknown') as found from q left join r on r.lang = q.lang and k = 1""")
def resolve_voice(s, d):
    """The voice of each language: what is asked for by its number, else the first whose name holds it in any case, else as it is if it looks like
    an id (18 letters and digits or more), else unknown (no voice); where nothing is asked for, the default of language and gender, else
    of the library one of that gender if there is one, native if there is one, else the default of language 0."""
    n = table(s, d, "nation")
    k, text = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    spec = (
        F.when(k % 5 == 0, (k * 3 + 1).cast("string")).when(k % 5 == 1, F.concat(F.lit("R#0000000"), F.lpad(text, 2, "0")))
        .when(k % 5 == 2, F.concat(F.lit("voice0123456789abc"), text)).when((k % 5 == 3) & (k > 10), "no such")
    )
    q = n.select(k.alias("lang"), F.when(k % 2 == 0, "female").otherwise("male").alias("g"), spec.alias("spec"))
    b = F.broadcast(q)  # nation: 25 rows at every size
    v = voices(s, d).withColumn("voice", F.col("s_suppkey").cast("string"))
    option = lambda df, voice, rung, a=F.lit(""), c=F.lit(False), name=F.lit(""): df.select("lang", F.struct(F.lit(rung).alias("rung"), a.alias("a"), c.alias("c"), name.alias("n"), voice.alias("voice")).alias("o"))
    number = F.lpad("voice", 12, "0")
    df = s.createDataFrame(list(DEFAULT_VOICES), "lang int, g string, dv string")
    o = option(v.join(b, F.col("spec") == F.col("voice")), F.col("voice"), 0)
    o = o.unionByName(option(v.join(b, F.contains(F.lower("name"), F.lower("spec"))), F.col("voice"), 1, name=number))
    o = o.unionByName(option(q.filter(F.col("spec").rlike(r"^[\p{L}\p{N}]{18,}$")), F.col("spec"), 2))
    o = o.unionByName(option(q.filter("spec is null").join(df, ["lang", "g"]), F.col("dv"), 3))
    lib = v.withColumn("lang", F.explode(F.array_distinct("speaks"))).join(b.filter("spec is null"), "lang")
    o = o.unionByName(option(lib, F.col("voice"), 4, F.when(F.col("gender") == F.col("g"), "0").otherwise("1"), F.col("lang") != F.col("native"), F.concat("name", number)))
    o = o.unionByName(option(q.filter("spec is null").join(df.filter("lang = 0").drop("lang"), "g"), F.col("dv"), 5))
    best = o.groupBy("lang").agg(F.min("o").alias("o"))
    names = F.array(*map(F.lit, ("number", "name", "id", "default", "library", "fallback")))
    return q.join(best, "lang", "left").select("lang", F.col("o.voice").alias("voice"), F.coalesce(F.get(names, F.col("o.rung")), F.lit("unknown")).alias("found"))
