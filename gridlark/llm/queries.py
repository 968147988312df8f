"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.chat import prefix_target_examples, read_back
from gridlark.llm.collocations import collocations
from gridlark.llm.common import table
from gridlark.llm.decontaminate import contamination
from gridlark.llm.exact_dedup import exact_dedup
from gridlark.llm.language_model import log_bilinear_scores
from gridlark.llm.line_dedup import line_dedup_report
from gridlark.llm.near_dedup import near_duplicates
from gridlark.llm.packing import pack
from gridlark.llm.pii import find_personal_data
from gridlark.llm.repeats import remove_repeats
from gridlark.llm.runs import periodic_runs
from gridlark.llm.toxicity import graded_labels, score_severity
from gridlark.llm.url_filter import Rule, judge_urls


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose id is not held out."""
    return log_bilinear_scores(table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of all documents."""
    return line_dedup_report(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The rules of op4.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_personal_data(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 512 to 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all documents, learned from their labels."""
    return score_severity(table(spark, sf_dir, "documents"), graded_labels(table(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup over all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by 2-word shingles at similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of all strings of 200 bytes that occur more than once in the documents."""
    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, as read back from their training examples."""
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(odd)
    return read_back(prefix_target_examples(turns))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"), min_count=100, longest=5, top=2000)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) of which those with crc32(doc_id) divisible by 10 repeat a part of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i).cast("int"))), " ")).otherwise("")

    # an array of one, so that the words are bound once
    words = F.array(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(F.transform(words, repeated), F.lit(0))).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, some of which are made to repeat."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    order = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    longest = found.withColumn("best", F.try_element_at(order, F.lit(1)))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    length = -F.col("best.shorter")
    return longest.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(F.lit(1000) * length / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_repeated_substrings": op10_repeated_substrings,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_collocations": op12_collocations,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": """
        with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
        g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by 1)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)""",
    "op9_near_dedup": """
        with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
        s as materialized (select doc_id, list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as sh from w),
        e as materialized (select doc_id, len(sh) as n, hash(x) as x from (select doc_id, sh, unnest(sh) as x from s)),
        links as materialized (select a, b from (select x.doc_id as a, y.doc_id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as common from e x join e y on x.x = y.x and x.doc_id <> y.doc_id
            where 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by 1, 2) where 100 * common >= 80 * (na + nb - common)),
        reach as (select doc_id as id, doc_id as r from documents union select id, b from reach join links on r = a),
        c as (select id as doc_id, min(r) as component_id from reach group by 1)
        select doc_id, cast(len(sh) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join c using (doc_id)""",
    "op10_repeated_substrings": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        w as materialized (select doc_id, i, md5(substr(h, cast(2 * i + 1 as bigint), 400)) as k from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) as i from d)),
        r as (select doc_id, i from w where k in (select k from w group by 1 having count(*) > 1)),
        g as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as opens from r),
        runs as (select doc_id, min(i) as a, max(i) + 200 as b from (select doc_id, i, sum(opens) over (partition by doc_id order by i) as g from g) group by doc_id, g),
        pieces as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as s, a as e from runs union all select doc_id, max(b), any_value(length(h) // 2) from runs join d using (doc_id) group by 1),
        kept as (select doc_id, string_agg(substr(h, cast(2 * s + 1 as bigint), cast(2 * (e - s) as bigint)), '' order by s) as k from pieces join d using (doc_id) group by 1),
        sums as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from runs group by 1)
        select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
        from d left join sums using (doc_id) left join kept using (doc_id)""",
    "op11_chat_formatting": r"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, x, case x when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) t(x)),
        b as (select *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?(SYS|ROLE)>>'))
            + case role when 'user' then 15 when 'assistant' then 9 when 'system' then 17 else 20 + length(role) + length(regexp_replace(role, '[^\\\n]', '', 'g')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]|<</?(SYS|ROLE)>>')) end as size from c),
        p as (select *, sum(size) over w as prefix, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back from b window w as (partition by conv_id order by turn, role, text rows unbounded preceding))
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            cast(sum(prefix) filter (role = 'assistant' or back = 1) as bigint) as formatted_chars from p group by 1""",
    "op12_collocations": r"""
        with d as (select row_number() over () as id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        w as materialized (select lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\n-\r]')) as p from d)),
        f as materialized (select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase, count(*) as n from (select lang, w, unnest(range(1, len(w) + 1)) as i from w), (select unnest(range(1, 6)) as m) where i + m - 1 <= len(w) group by 1, 2, 3 having m = 1 or count(*) >= 100),
        totals as (select lang, sum(n) as n from f where m = 1 group by 1),
        c as (select lang, m, phrase, n as a, string_split(phrase, ' ') as w from f where m > 1),
        cuts as (select c.lang, c.m, phrase, a, k, array_to_string(w[1 : k], ' ') as x, array_to_string(w[k + 1 : m], ' ') as y from c, (select unnest(range(1, 5)) as k) where k < m),
        s as (select cuts.lang, cuts.m, cuts.phrase, a, k, l.n as l, r.n as r, t.n as n, cast(1000 as hugeint) * a * t.n // (cast(l.n as hugeint) * r.n) as score from cuts join f l on cuts.lang = l.lang and x = l.phrase join f r on cuts.lang = r.lang and y = r.phrase join totals t on cuts.lang = t.lang),
        best as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        kept as (select * from best b where not exists (select 1 from c where c.lang = b.lang and c.m > b.m and c.a >= b.a and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
        select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000""",
}
