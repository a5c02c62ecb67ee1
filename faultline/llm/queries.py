"""Queries opN_<name>: each applies one operator to its whole table and derives the digests of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, crf, exactdup, license, neardup, packing, quality, runs, secrets, sharding, tokenfile, toxicity


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; the digests are of the ids and of the decoded text."""
    done = bpe.encode_decode(table(spark, sf_dir))
    digits = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_refused")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir), words=2)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append, compact and commit; each document as it is read from the committed version."""
    stored = sharding.shard(table(spark, sf_dir))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return stored.select("row.doc_id", "arrival", "shard", "tier", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir)).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exactdup.decide(table(spark, sf_dir))
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans."""
    found = secrets.scan(table(spark, sf_dir))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    scores = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir))


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    scores = crf.score(docs, crf.fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir))


def with_turns(docs: DataFrame) -> DataFrame:
    """documents, of which one in ten repeats some of its words to its end: h = crc32 of the decimal doc_id, g = floor(h / 10); with h % 10 = 0 and words, word i >= a becomes
    word a + (i - a) % p of the n, a = g % n, p = 1 + floor((n - a) / (3 + g % 8))."""
    h, words = "crc32(cast(cast(doc_id as string) as binary))", r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    marked = docs.select("doc_id", "text", F.expr(f"{h} % 10 = 0").alias("turned"), F.expr(f"{h} div 10").alias("g"))
    marked = marked.withColumn("words", F.expr(f"case when turned then {words} end")).withColumn("n", F.expr("size(words)"))
    marked = marked.withColumn("a", F.expr("case when n > 0 then cast(g % n as int) end")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    turned = "concat_ws(' ', transform(sequence(0, n - 1), i -> words[case when i >= a then a + (i - a) % p else i end]))"
    return marked.select("doc_id", F.expr(f"case when turned and n > 0 then {turned} else text end").alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, with_turns; the best run has the greatest exact length / period."""
    found = runs.find(with_turns(table(spark, sf_dir)))
    kind = "struct<start: bigint, length: bigint, period: bigint>"
    best = F.expr(f"aggregate(runs, cast(null as {kind}), (b, r) -> case when b is null or r.length * b.period > b.length * r.period then r else b end)")
    said = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    rows = found.withColumn("best", best)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality_rules, op3_near_dedup, op4_sharding, op5_license_scan, op6_packing, op7_exact_dedup, op8_secret_scan, op9_toxicity, op10_token_files, op11_line_quality, op12_collocations, op13_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": QUALITY_SQL, "op3_near_dedup": NEAR_SQL, "op4_sharding": SHARDING_SQL, "op7_exact_dedup": EXACT_SQL, "op12_collocations": COLLOCATION_SQL}


WORD = r"[^\x20\x09-\x0D]+"
_RULE_NAMES = list(quality.RULES)
#: Measures by words and lines, failures by host, the prior of each rule by moments, and the hosts that a shrunk rate refuses.
QUALITY_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text, nullif(lower(trim(source)), '') as value from documents),
w as (select *, regexp_extract_all(text, '{WORD}') as words, string_split(text, chr(10)) as lines, coalesce(nullif(regexp_extract(value, '^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1), ''), value) as host from d),
win as (select doc_id, k, words[k] as a, words[k + 1] as b, words[k + 2] as c from (select doc_id, words, unnest(range(1, len(words) - 1)) as k from w)),
twice as (select doc_id, k from win qualify count(*) over (partition by doc_id, a, b, c) > 1),
rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, k + unnest([0, 1, 2]) as p from twice) group by doc_id),
ln as (select doc_id, count(*) as n_lines, count(distinct line) as n_different from (select doc_id, unnest(lines) as line from w) where regexp_matches(line, '{WORD}') group by doc_id),
m as (select w.doc_id, host, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_lines - n_different, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join rep using (doc_id) left join ln using (doc_id)),
h as (select host, count(*) as n, {', '.join(f'count(*) filter (where {rule}) as f_{r}' for r, rule in quality.RULES.items())} from m where host is not null group by host),
r as (select host, n::double as n, unnest({_RULE_NAMES}) as rule, unnest([{', '.join(f'f_{r}' for r in _RULE_NAMES)}])::double as f from h),
s as (select rule, count(*) as hosts, sum(n) as n, sum(f) as f, sum(n * n) as n2, sum(f * f / n) as f2 from r group by rule),
p as (select *, least(greatest(f / n, 1e-6), 1 - 1e-6) as p, n - n2 / n - (hosts - 1) as free from s),
q as (select *, least(greatest(case when free > 0 then ((f2 - f * f / n) / (p * (1 - p)) - (hosts - 1)) / free else 0.5 end, 1e-3), 0.5) as spread from p),
prior as (select rule, case when hosts < 2 then 1 else p * (1 / spread - 1) end as a, case when hosts < 2 then 1 else (1 - p) * (1 / spread - 1) end as b from q),
refused as (select distinct host from r join prior using (rule) where (f + a) / (n + a + b) >= {quality.MAX_RATE}),
v as (select m.*, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed, host in (from refused) as refused from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(refused, false) as kept, coalesce(refused, false) as host_refused from v
"""

#: All pairs of different sets that share a shingle and may be alike by size, their exact overlaps, and the closure of links.
NEAR_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
s as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) = 1 then w else list_sort(list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) end as shingles from d),
c as (select min(doc_id) as rep, shingles, len(shingles) as n from s where len(shingles) > 0 group by shingles),
e as (select rep, n, unnest(shingles) as g from c),
pairs as (select x.rep as a, y.rep as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as common from e x join e y on x.g = y.g and x.rep < y.rep and greatest(x.n, y.n) * {neardup.SIMILAR} <= least(x.n, y.n) * 100 group by x.rep, y.rep),
l as (select a, b from pairs where 100 * common >= {neardup.SIMILAR} * (n + m - common)),
t as (select a, b from l union select b, a from l),
reach(x, y) as (select rep, rep from c union select reach.x, t.b from reach join t on t.a = reach.y),
least as (select x as rep, min(y) as component from reach group by x)
select s.doc_id, len(s.shingles)::bigint as n_shingles, coalesce(component, s.doc_id) as component_id, coalesce(s.doc_id = coalesce(component, s.doc_id), true) as kept
from s left join c on c.shingles = s.shingles and len(s.shingles) > 0 left join least using (rep)
"""


SHARDING_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(cast(floor(doc_id / {sharding.ARRIVAL_IDS}.0) as bigint), -1) as arrival from documents),
a as (select arrival, sum(strlen(text))::bigint as bytes from d group by arrival),
t as (select *, {' + '.join(f'(bytes >= {sharding.BASE_BYTES * sharding.FANOUT**k})::int' for k in range(sharding.TIERS))} as tier from a),
r as (select *, case when bytes < {sharding.TARGET_BYTES} then coalesce(sum(case when bytes < {sharding.TARGET_BYTES} then bytes end) over (partition by tier order by arrival rows between unbounded preceding and 1 preceding), 0)::bigint // {sharding.TARGET_BYTES} end as run from t),
p as (select *, case when run is not null and count(*) over (partition by tier, run) >= {sharding.MIN_MERGE} then 't' || tier || '-r' || run else 'a' || arrival end as shard from r),
s as (select shard, sum(bytes)::bigint as bytes from p group by shard)
select d.doc_id, d.arrival, p.shard, ({' + '.join(f'(s.bytes >= {sharding.BASE_BYTES * sharding.FANOUT**k})::int' for k in range(sharding.TIERS))})::int as tier, strlen(d.text)::bigint as n_bytes, sha256(d.text) as text_sha256
from d join p using (arrival) join s using (shard)
"""

EXACT_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
r as (select *, row_number() over w as place, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size
  from d window w as (partition by text_sha256 order by points desc, doc_id nulls last))
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from r
"""

#: All phrases of one to five words inside pieces, their cuts, and the phrases inside longer ones.
COLLOCATION_SQL = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
t as (select lang, sum(len(words))::hugeint as n from w group by lang),
st as (select lang, words, unnest(range(1, len(words) + 1)) as i from w),
g as (select lang, words[i : i + k - 1] as phrase from (select *, unnest(range(1, least(5, len(words) - i + 1) + 1)) as k from st)),
f as (select lang, phrase, len(phrase) as k, count(*)::hugeint as f from g group by lang, phrase having count(*) >= {collocations.MIN_COUNT}),
c as (select lang, phrase, k, f, unnest(range(1, k)) as cut from f where k > 1),
s as (select c.lang, c.phrase, c.k, c.f as a, cut, l.f as l, r.f as r, t.n, (1000 * c.f * t.n) // (l.f * r.f) as score from c join t on t.lang = c.lang
  join f l on l.lang = c.lang and l.phrase = c.phrase[1 : cut] join f r on r.lang = c.lang and r.phrase = c.phrase[cut + 1 : c.k]),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inside as (select lang, f, k, phrase[i : j] as part from (select *, unnest(range(i + 1, k + 1)) as j from (select *, unnest(range(1, k)) as i from f where k > 2)) where j - i + 1 < k),
gone as (select distinct b.lang, b.phrase from b join inside on inside.lang = b.lang and inside.part = b.phrase and 100 * inside.f >= {collocations.INSIDE_PERCENT} * b.a),
kept as (select lang, array_to_string(phrase, ' ') as phrase, a, l, r, n, score from b where not exists (from gone where gone.lang = b.lang and gone.phrase = b.phrase))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from kept
qualify rank <= {collocations.TOP}
"""
