"""Re-filed documents withdraw rows, findings and scores follow: streams over bucketed snapshots, and uploads that repeat.

What counts for a filing is its created_at, not its arrival: of the filings of one kind and period the latest stands, whichever micro-batch brings it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.functions import predicates as p
from inspectra.operators.documents import superseded
from inspectra.operators.facts import USABLE
from inspectra.operators.findings import code_scores, upsert
from inspectra.plans.materialise import cut, shared_dir
from inspectra.plans.registry import query
from inspectra.sources.views import VIEWS, frame
from inspectra.streaming.documents import unique_uploads
from inspectra.streaming.snapshots import Snapshots

c = F.col
FILING = "document_id long, establishment_id long, doc_type string, period_start date, period_end date, status string, created_at timestamp"
PERIOD = ["establishment_id", "period_start", "period_end"]
REQUEST = "establishment_id long, period_start date, period_end date"
FINDING = "establishment_id long, period_start date, period_end date, dedupe_key string, status string, severity string, affected long"


class Register:
    """T5: the filed documents and their fact rows, kept up by micro-batches of filings.

    A filing is a document's state; one with a known document_id replaces the former state (its period may differ; its establishment never does). A document stands if it is usable
    and not superseded. Fact rows of documents that stand no longer, or stand with another state, are withdrawn by an anti-join; rows of those that newly
    stand are extracted. Former and new periods of both are asked for.
    """

    def __init__(self, spark: SparkSession, folder: str, rows: str, extract: Callable[[DataFrame], DataFrame], buckets: int = 64):
        """rows: schema of the fact rows that `extract` gives for documents; both hold document_id and establishment_id."""
        self.spark, self.folder, self.extract = spark, folder, extract
        self.documents = Snapshots(spark, f"{folder}/documents", f"{FILING}, stands boolean", "establishment_id", buckets)
        self.rows = Snapshots(spark, f"{folder}/rows", rows, "establishment_id", buckets)

    def take(self, filings: DataFrame, number: int) -> DataFrame:
        """Micro-batch `number` of filings; the periods (establishment_id, period_start, period_end) that are to be assessed again."""
        names = [f.split()[0] for f in FILING.split(", ")]
        new = cut(filings.groupBy("document_id").agg(F.max_by(F.struct(*names[1:]), F.struct("created_at", "status", "period_start", "period_end")).alias("d")).select("document_id", "d.*"))
        touched = self.documents.touched(new)
        known = cut(self.documents.read(number - 1, touched))
        states = known.drop("stands").join(new, "document_id", "left_anti").unionByName(new)
        now = superseded(states).withColumn("stands", p.truth(~c("superseded") & c("status").isin(USABLE))).drop("superseded")
        now = cut(now)
        self.documents.write(now, touched, number)
        before = known.where("stands").select("document_id", *PERIOD).join(new.select("document_id", F.lit(True).alias("again")), "document_id", "left")
        after = now.where("stands")
        lost = cut(before.join(after.select("document_id"), "document_id", "left_anti").unionByName(before.where("again")).select("document_id", *PERIOD).distinct())
        gained = cut(after.join(before.where("again is null").select("document_id"), "document_id", "left_anti"))
        changed = self.rows.touched(lost, gained)
        stay = self.rows.read(number - 1, changed).join(lost.select("document_id"), "document_id", "left_anti")
        self.rows.write(stay.unionByName(self.extract(gained)), changed, number)
        asked = lost.select(*PERIOD).union(gained.select(*PERIOD)).where("period_start is not null").distinct()
        asked.write.mode("overwrite").parquet(f"{self.folder}/requests/number={number}")
        return self.spark.read.schema(REQUEST).parquet(f"{self.folder}/requests/number={number}")


class Assessments:
    """Findings as bucketed snapshots, and score cards that are only ever added.

    assess(requests, rows): outcomes (establishment_id, period_start, period_end, dedupe_key, state, severity, affected) of the requested periods over their rows.
    score(findings): cards of the establishments whose findings these are.
    """

    def __init__(self, spark: SparkSession, folder: str, assess: Callable[[DataFrame, DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.folder, self.assess, self.score = spark, folder, assess, score
        self.findings = Snapshots(spark, f"{folder}/findings", FINDING, "establishment_id", buckets)

    def take(self, requests: DataFrame, rows: Snapshots, number: int) -> None:
        requests = cut(requests.distinct())
        touched = self.findings.touched(requests)
        current = cut(self.assess(requests, rows.read(number, touched)))
        former = cut(self.findings.read(number - 1, touched))
        places = current.select("dedupe_key", *PERIOD).union(former.select("dedupe_key", *PERIOD)).distinct()
        self.findings.write(upsert(current, former.drop(*PERIOD)).join(places, "dedupe_key").select([f.split()[0] for f in FINDING.split(", ")]), touched, number)
        asked = requests.select("establishment_id").distinct()
        self.score(self.findings.read(number, touched).join(asked, "establishment_id", "left_semi")).write.mode("overwrite").parquet(f"{self.folder}/cards/number={number}")

    def cards(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/cards").parquet(f"{self.folder}/cards")


def keep_register(filings: DataFrame, checkpoint: str, register: Register, assessments: Assessments | None = None) -> None:
    """Run a stream of filings to the end of what is there."""

    def step(rows: DataFrame, number: int) -> None:
        requests = register.take(rows, number)
        if assessments is not None:
            assessments.take(requests, register.rows, number)

    filings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


VIEWS["x_filed_row"] = """
SELECT CAST(l_orderkey AS BIGINT) AS document_id, CAST(l_linenumber AS BIGINT) AS row_number, CAST(l_partkey AS BIGINT) AS worker_key, CAST(round(l_extendedprice * 100) AS BIGINT) AS gross_paise FROM lineitem
"""
#: Every third document is filed in a second round; there a twelfth of the first ones comes again, as rejected or for the month before.
VIEWS["x_filing_first"] = """
SELECT document_id, establishment_id, doc_type, period_start, period_end, status, CAST(created_at AS TIMESTAMP) AS created_at FROM x_document WHERE document_id % 3 <> 0
"""
VIEWS["x_filing_second"] = """
SELECT document_id, establishment_id, doc_type, period_start, period_end, status, CAST(created_at AS TIMESTAMP) AS created_at FROM x_document WHERE document_id % 3 = 0
UNION ALL
SELECT document_id, establishment_id, doc_type, CASE WHEN document_id % 2 = 0 THEN period_start ELSE CAST(date_trunc('month', period_start - INTERVAL 1 DAY) AS DATE) END, CASE WHEN document_id % 2 = 0 THEN period_end ELSE CAST(period_start - INTERVAL 1 DAY AS DATE) END,
       CASE WHEN document_id % 2 = 0 THEN 'REJECTED' ELSE status END, CAST(created_at AS TIMESTAMP)
FROM x_document WHERE document_id % 3 = 1 AND document_id % 8 IN (0, 1)
"""
ROWS = "document_id long, establishment_id long, doc_type string, period_start date, period_end date, row_number long, worker_key long, gross_paise long"


def rounds(spark: SparkSession, folder: str, parts: list[DataFrame], schema: str) -> DataFrame:
    """A stream of micro-batches, one for each DataFrame."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _extract(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    stored = frame(spark, sf_dir, "x_filed_row")
    return lambda documents: documents.select("document_id", "establishment_id", "doc_type", "period_start", "period_end").join(stored, "document_id").select([f.split()[0] for f in ROWS.split(", ")])


def _assess(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """A toy of a rule over real rows: a period's average line of more than 36,000 rupees is a violation, affecting its dearer rows."""
    per = rows.groupBy(*PERIOD).agg(F.sum("gross_paise").alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(c("gross_paise") > 3_600_000).alias("affected"))
    both = requests.join(per, PERIOD, "left")
    state = F.when(c("n").isNull(), "not_assessed").when(c("total") > 3_600_000 * c("n"), "violation").otherwise("pass")
    return both.select(*PERIOD, F.concat_ws("|", *PERIOD).alias("dedupe_key"), state.alias("state"), F.lit("MEDIUM").alias("severity"), F.coalesce("affected", F.lit(0)).alias("affected"))


def _score(findings: DataFrame) -> DataFrame:
    named = findings.select("establishment_id", "status", "severity", F.lit("WAGES").alias("code"), F.lit("NON_COMPLIANCE").alias("kind"), F.lit("T6").alias("rule_id"), F.lit("STATUTE").alias("rule_basis"), c("affected").alias("affected_worker_count"), F.lit(None).cast("double").alias("extraction_confidence"))
    return code_scores(named, ["establishment_id"])


_STANDS = """
SELECT * FROM (SELECT *, status IN ('EXTRACTED', 'NEEDS_REVIEW', 'VERIFIED', 'EVALUATED') AND (period_start IS NULL OR document_id = first_value(document_id) OVER (PARTITION BY establishment_id, doc_type, period_start, period_end, status IN ('REJECTED', 'FAILED') ORDER BY created_at DESC, document_id DESC)) AS stands FROM {}) WHERE stands
"""
_REGISTER = f"""
WITH both_ AS (SELECT * FROM x_filing_first WHERE document_id NOT IN (SELECT document_id FROM x_filing_second) UNION ALL SELECT * FROM x_filing_second),
one AS ({_STANDS.format('x_filing_first')}), two AS ({_STANDS.format('both_')}),
again AS (SELECT document_id FROM x_filing_second),
lost AS (SELECT * FROM one WHERE document_id NOT IN (SELECT document_id FROM two) OR document_id IN (SELECT document_id FROM again)),
gained AS (SELECT * FROM two WHERE document_id NOT IN (SELECT document_id FROM one) OR document_id IN (SELECT document_id FROM again)),
asked1 AS (SELECT DISTINCT establishment_id, period_start, period_end FROM one),
asked2 AS (SELECT DISTINCT establishment_id, period_start, period_end FROM (SELECT * FROM lost UNION ALL SELECT * FROM gained))
"""


@query("t5_refilings", f"""{_REGISTER}
SELECT coalesce(establishment_id, e) AS establishment_id, coalesce(period_start, p) AS period_start, documents, workers, gross_paise, coalesce(asked, 0)::BIGINT AS asked
FROM (SELECT establishment_id, period_start, period_end, count(DISTINCT document_id) AS documents, count(DISTINCT worker_key) AS workers, sum(gross_paise)::BIGINT AS gross_paise FROM two JOIN x_filed_row USING (document_id) GROUP BY 1, 2, 3)
FULL JOIN (SELECT establishment_id AS e, period_start AS p, period_end AS pe, count(*) AS asked FROM (SELECT * FROM asked1 UNION ALL SELECT * FROM asked2) GROUP BY 1, 2, 3) ON establishment_id = e AND period_start = p AND period_end = pe""")
def _t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of filings; the rows that stand by period, and how often each period was asked for."""
    folder = _folder(spark)
    register = Register(spark, folder, ROWS, _extract(spark, sf_dir), 16)
    keep_register(rounds(spark, f"{folder}/in", [frame(spark, sf_dir, "x_filing_first"), frame(spark, sf_dir, "x_filing_second")], FILING), f"{folder}/checkpoint", register)
    stand = register.rows.read(1).groupBy(*PERIOD).agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("worker_key").alias("workers"), F.sum("gross_paise").alias("gross_paise"))
    asked = spark.read.schema(f"{REQUEST}, number int").option("basePath", f"{folder}/requests").parquet(f"{folder}/requests").groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("asked"))
    return stand.join(asked, PERIOD, "full_outer").select("establishment_id", "period_start", "documents", "workers", "gross_paise", F.coalesce("asked", F.lit(0)).alias("asked"))


_STATE = """SELECT {asked}.*, CASE WHEN n IS NULL THEN 'not_assessed' WHEN total > 3600000 * n THEN 'violation' ELSE 'pass' END AS state, coalesce(affected, 0) AS affected FROM {asked} LEFT JOIN (
 SELECT establishment_id, period_start, period_end, sum(gross_paise) AS total, count(*) AS n, count(*) FILTER (WHERE gross_paise > 3600000) AS affected FROM {rows} JOIN x_filed_row USING (document_id) GROUP BY 1, 2, 3) USING (establishment_id, period_start, period_end)"""


@query("t6_assessments", f"""{_REGISTER},
s1 AS ({_STATE.format(asked='asked1', rows='one')}), s2 AS ({_STATE.format(asked='asked2', rows='two')}),
f1 AS (SELECT establishment_id, period_start, period_end, 'OPEN' AS status, affected FROM s1 WHERE state = 'violation'),
f2 AS (SELECT * FROM (SELECT coalesce(f1.establishment_id, s2.establishment_id) AS establishment_id, coalesce(f1.period_start, s2.period_start) AS period_start, coalesce(f1.period_end, s2.period_end) AS period_end,
 CASE WHEN state = 'violation' THEN 'OPEN' WHEN state = 'pass' AND status IS NOT NULL THEN 'RESOLVED' ELSE status END AS status, CASE WHEN state = 'violation' THEN s2.affected ELSE f1.affected END AS affected
 FROM f1 FULL JOIN s2 ON f1.establishment_id = s2.establishment_id AND f1.period_start = s2.period_start AND f1.period_end = s2.period_end) WHERE status IS NOT NULL),
cards AS (SELECT number, establishment_id, round_even(greatest(0, least(100, 100 * exp(-points / 120))), 1) AS score FROM (
 SELECT number, establishment_id, sum(CASE WHEN status = 'OPEN' THEN 8 * CASE WHEN affected <= 1 THEN 1 ELSE least(3, 1 + log10(affected)) END ELSE 0 END) AS points
 FROM (SELECT 0 AS number, * FROM f1 WHERE establishment_id IN (SELECT establishment_id FROM asked1) UNION ALL SELECT 1, * FROM f2 WHERE establishment_id IN (SELECT establishment_id FROM asked2)) GROUP BY 1, 2))
SELECT f2.establishment_id, period_start, status, affected, cards, last_score FROM f2 LEFT JOIN (SELECT establishment_id, count(*) AS cards, arg_max(score, number) AS last_score FROM cards GROUP BY 1) USING (establishment_id)""")
def _t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after both rounds, with the number of cards added for the establishment and the score of the last."""
    folder = _folder(spark)
    register, done = Register(spark, folder, ROWS, _extract(spark, sf_dir), 16), Assessments(spark, folder, _assess, _score, 16)
    keep_register(rounds(spark, f"{folder}/in", [frame(spark, sf_dir, "x_filing_first"), frame(spark, sf_dir, "x_filing_second")], FILING), f"{folder}/checkpoint", register, done)
    cards = done.cards().groupBy("establishment_id").agg(F.count(F.lit(1)).alias("cards"), F.max_by("score", "number").alias("last_score"))
    return done.findings.read(1).join(cards, "establishment_id", "left").select("establishment_id", "period_start", "status", "affected", "cards", "last_score")


#: Uploads of eight rounds of four days. The time of an upload is its round's first day. A thirteenth of the first ones arrives five rounds late, when it is older than the watermark of the round before.
VIEWS["x_upload_round"] = """
SELECT organisation_id, client_key, CASE WHEN late THEN own + 5 ELSE own END AS round, CAST(date_trunc('day', TIMESTAMP '2024-01-01 00:00:00' + own * INTERVAL 4 DAY) AS TIMESTAMP) AS created_at, late
FROM (SELECT *, event_id % 13 = 0 AND own <= 2 AS late FROM (SELECT event_id, CAST(user_id % 7 AS BIGINT) AS organisation_id, 'c' || CAST(event_id % 211 AS VARCHAR(20)) AS client_key, least(7, CAST(floor((day(ts) - 1) / 4) AS INT)) AS own FROM events) AS e) AS u
"""
UPLOAD = "organisation_id long, client_key string, round int, created_at timestamp"


@query("t4_unique_uploads", """SELECT organisation_id, client_key, unnest(kept) AS round FROM (SELECT organisation_id, client_key, list_reduce(list_prepend([]::INT[], list([round] ORDER BY round)), lambda a, x: CASE WHEN len(a) = 0 OR x[1] - a[-1] > 4 THEN list_concat(a, x) ELSE a END) AS kept
 FROM (SELECT DISTINCT organisation_id, client_key, round FROM x_upload_round WHERE NOT late) GROUP BY 1, 2)""")
def _t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First uploads of each key in eight micro-batches: repeats within six days are dropped, a key comes again when its state has expired, late ones are never taken."""
    folder = _folder(spark)
    uploads = cut(frame(spark, sf_dir, "x_upload_round"))
    parts = [uploads.where(c("round") == n).select("organisation_id", "client_key", "round", "created_at") for n in range(8)]
    found = unique_uploads(rounds(spark, f"{folder}/in", parts, UPLOAD), "6 days")
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(UPLOAD).parquet(f"{folder}/out").select("organisation_id", "client_key", "round")
