"""Reads derived from lineitem, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (name, SQL) of common table expressions; the last is reads(cell_id, umi, clone_id).
CTES = [
    ("n", "select cast(floor(count(*) / 30) as bigint) nc, cast(floor(count(*) / 300) as bigint) nf from lineitem"),
    ("b", "select l_orderkey % nc c, nf, l_partkey p, l_suppkey s, l_linenumber ln, l_discount d from lineitem cross join n"),
    (
        "f",
        "select *, case when c % 97 = 0 and ln % 2 = 0 then (c + 7) % nf when s % 40 = 0 then (c + 1) % nf else c % nf end fam, "
        "case when p % 4 = c % 5 then (p + 1) % 4 else p % 4 end idx from b",
    ),
    (
        "g",
        "select *, translate(substring(md5(concat('f', cast(fam as string), '-', cast(idx as string))), 1, 30), '0123456789abcdef', 'ACGTACGTACGTACGT') t, "
        "translate(substring(md5(concat('u', cast(fam as string), '-', cast(idx as string), '-', cast(s % 3 as string))), 1, 10), '0123456789abcdef', 'ACGTACGTACGTACGT') umi from f",
    ),
    ("h", "select c, umi, ln, d, case when p % 50 = 7 then concat(substring(t, 1, cast(s % 30 as int)), 'A', substring(t, cast(s % 30 as int) + 2, 30)) else t end t from g"),
    (
        "reads",
        "select concat('CELL', lpad(cast(c as string), 6, '0')) cell_id, umi, case when ln = 6 then concat(repeat('-', 12), substring(t, 13, 18)) "
        "when ln = 5 then concat(substring(t, 1, 25), '-----') when ln = 7 and d > 0.05 then concat(substring(t, 1, 2), '0', substring(t, 4, 27)) else t end clone_id from h",
    ),
]


def derived_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount"]
    text = "with " + ", ".join(f"{name} as ({sql})" for name, sql in CTES) + " select cell_id, umi, clone_id from reads"
    return spark.sql(text.replace("from lineitem", "from {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns))


#: (name, SQL) up to alignments with the lengths of their operations: a clipped, b aligned, c inserted, d aligned, e deleted or skipped, f aligned, g clipped.
ALIGNMENT_CTES = [
    (
        "lens",
        "select l_orderkey o, l_partkey p, l_suppkey s, l_linenumber ln, l_suppkey % 9 a, 1 + l_partkey % 12 b, l_orderkey % 4 c, 1 + l_suppkey % 11 d, l_partkey % 7 e, "
        "1 + l_orderkey % 9 f, (l_partkey + l_suppkey) % 10 g from lineitem",
    ),
    (
        "alignments",
        "select case when p % 50 = 0 then 'other' else 'chrX' end rname, 70 + (o * 7 + ln) % 70 pos, a, b, c, d, e, f, g, "
        "concat(case when p % 3 = 0 then '2H' else '' end, case when a > 0 then concat(cast(a as string), 'S') else '' end, cast(b as string), case when ln = 3 then '=' else 'M' end, "
        "case when c > 0 then concat(cast(c as string), 'I') else '' end, cast(d as string), case when ln = 4 then 'X' else 'M' end, "
        "case when e > 0 then concat(cast(e as string), case when ln % 2 = 0 then 'D' else 'N' end) else '' end, cast(f as string), 'M', "
        "case when g > 0 then concat(cast(g as string), 'S') else '' end) cigar, "
        "substring(translate(concat(md5(concat(cast(o as string), '-', cast(ln as string))), md5(concat(cast(p as string), '-', cast(s as string)))), "
        "'0123456789abcdef', 'ACGTACGTACGTACGT'), 1, cast(a + b + c + d + f + g as int)) seq, "
        "case when o % 37 > 0 then concat('CELL', cast(s % 20 as string), '-1') end cb, case when p % 41 > 0 then case when p % 43 = 0 then '' else concat('U', cast(p % 90 as string)) end end ub from lens",
    ),
]


def derived_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rname, pos, cigar, seq, tags) with the tags CB and UB, of all rows of lineitem."""
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    text = "with " + ", ".join(f"{name} as ({sql})" for name, sql in ALIGNMENT_CTES)
    text += " select rname, pos, cigar, seq, map_filter(map('CB', cb, 'UB', ub), (k, v) -> v is not null) tags from alignments"
    return spark.sql(text.replace("from lineitem", "from {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns))
