"""The given tables seen as transcripts, posterior samples, alignments, sequences and gene models.

Every view covers its whole source table. Draws are shipping months, so after the first
aggregation a transcript has at most (months x files) cells, whatever its share of the rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.operators.blocks import chunks

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
REF_BASES = "ACGTACGTACGTACGTACGTACGTAC" * 2
# reads differ from the reference under the letters k, p and v
READ_BASES = "ACGTACGTACTTACGCACGTAGGTAC" * 2
QUALITIES = "IIIIIHHHHHIIII?IIIIFIIII5I" * 2
TILE = 40
READ_LENGTH = 25

#: Places of a text in a fragment number; no text is as long.
PLACES = 1 << 32


class Domain:
    """Views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def trs(self) -> DataFrame:
        """Suppliers as transcripts, nations as genes."""
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        length = 300 + F.floor(F.abs("s_acctbal") / 4).cast("int")
        return s.select(
            F.col("s_suppkey").alias("tid"), F.col("n_name").alias("gene"), F.col("s_name").alias("transcript"),
            length.alias("length"), (length - 150.0).alias("eff_length"),
        )

    @property
    def samples(self) -> DataFrame:
        """file_idx, cond, rep, tr, n, value: sales of a supplier in a month, per status and flag."""
        cond = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
        rep = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
        n = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        keyed = self.table("lineitem").select(cond.alias("cond"), rep.alias("rep"), F.col("l_suppkey").alias("tr"), n.cast("long").alias("n"), cents.alias("_c"))
        g = keyed.groupBy("cond", "rep", "tr", "n").agg(F.sum("_c").alias("_c"))
        return g.select((F.col("cond") * 3 + F.col("rep")).alias("file_idx"), "cond", "rep", "tr", "n", (F.col("_c").cast("double") / 100.0).alias("value"))

    @property
    def series(self) -> DataFrame:
        return self.samples.select("file_idx", "tr", "n", "value")

    @property
    def theta(self) -> DataFrame:
        """Samples scaled to sum 1 per (file, draw)."""
        s = self.series
        sums = s.groupBy("file_idx", "n").agg(F.sum("value").alias("_t"))
        return s.join(sums, ["file_idx", "n"]).select("file_idx", "tr", "n", (F.col("value") / F.col("_t")).alias("value"))

    @property
    def chains(self) -> DataFrame:
        """Files as chains; one unit per draw belongs to the noise transcript, so theta < 1."""
        s = self.series
        sums = s.groupBy("file_idx", "n").agg(F.sum("value").alias("_t"))
        theta = F.col("value") / (F.col("_t") + 1.0)
        return s.join(sums, ["file_idx", "n"]).select(F.col("file_idx").alias("chain"), "tr", "n", theta.alias("theta"))

    @property
    def curve(self) -> DataFrame:
        """A hyperparameter curve: one point per price class of the orders."""
        o = self.table("orders").groupBy(F.floor(F.col("o_totalprice") / 10000).alias("k")).agg(F.count(F.lit(1)).alias("c"))
        return o.select(F.log(F.col("k") * 10000.0 + 5000.0).alias("expr"), (1.0 + F.col("c") / 1000.0).alias("alpha"), (0.5 + F.col("k") * 0.1).alias("beta"))

    @property
    def parts(self) -> DataFrame:
        """Parts as transcripts of the alignments (tid = part key)."""
        length = 300 + 20 * F.col("p_size")
        return self.table("part").select(
            F.col("p_partkey").alias("tid"), F.concat_ws(".", "p_brand", "p_type").alias("gene"), F.concat_ws("-", F.translate("p_name", " ", "_"), "p_partkey").alias("transcript"),
            length.alias("length"), (length - 150.0).alias("eff_length"),
        )

    @property
    def raw_hits(self) -> DataFrame:
        """Order lines as alignments of a read (the order) to a transcript (the part)."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") + 1).alias("tr_id"), (-F.col("l_quantity") / 5.0).alias("lprob")
        )

    @property
    def hits(self) -> DataFrame:
        """The same with a noise alignment per read."""
        h = self.raw_hits
        noise = h.groupBy("read_id").agg((F.min("lprob") - 6.0).alias("lprob")).select("read_id", F.lit(0).cast("long").alias("tr_id"), "lprob")
        return h.unionByName(noise)

    @property
    def n_transcripts(self) -> int:
        """Transcripts of the alignments, noise included."""
        return self.table("part").agg(F.max("p_partkey")).first()[0] + 2

    def _letters(self, bases: str) -> Column:
        return F.regexp_replace(F.translate("text", LETTERS, bases), "[^ACGT]", "N")

    @property
    def seqs(self) -> DataFrame:
        """Documents as transcript sequences: whole texts, letters folded to ACGT, the rest N."""
        return self.table("documents").select(F.col("doc_id").alias("tid"), F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("source").alias("gene"), self._letters(REF_BASES).alias("seq"))

    @property
    def doc_trs(self) -> DataFrame:
        """Transcript table of the sequences."""
        length = F.length("text")
        return self.table("documents").select(
            F.col("doc_id").alias("tid"), F.col("source").alias("gene"), F.concat(F.lit("doc"), "doc_id").alias("transcript"), length.alias("length"), length.cast("double").alias("eff_length")
        )

    @property
    def tiles(self) -> DataFrame:
        """Fragments tiling every document: tid, p, flen, rl and the observed text pieces.

        Each tile of 40 bases starts a fragment of 60 to 100 bases, cut at the end of the text.
        """
        qual = F.regexp_replace(F.translate("text", LETTERS, QUALITIES), "[^5?FHI]", "8")
        pieces = self.table("documents").filter(F.length("text") > 0).select(
            F.col("doc_id").alias("tid"), chunks(self._letters(READ_BASES), TILE).alias("_r"), chunks(qual, TILE).alias("_q"), F.length("text").alias("tr_len")
        )

        def window(c: str, i: Column) -> Column:
            return F.concat_ws("", *[F.get(c, i + k) for k in range(3)])

        rows = F.transform(F.sequence(F.lit(0), F.size("_r") - 1), lambda i: F.struct((i * TILE).alias("p"), window("_r", i).alias("r"), window("_q", i).alias("q")))
        d = pieces.select("tid", "tr_len", rows.alias("_t")).select("tid", "tr_len", F.explode_outer("_t").alias("_t")).select("tid", "tr_len", "_t.*")
        flen = F.least(60 + (F.col("p") / TILE + F.col("tid") * 7) % 41, F.col("tr_len") - F.col("p")).cast("int")
        d = d.withColumn("flen", flen).withColumn("rl", F.least(F.lit(READ_LENGTH), F.col("flen")))

        def cut(c: str, at: Column) -> Column:
            return F.substring(F.col(c), at + 1, F.col("rl"))

        back = F.col("flen") - F.col("rl")
        return d.select(
            "tid", "p", "flen", "rl", "tr_len", (F.col("p") + back).alias("p2"),
            cut("r", F.lit(0)).alias("s1"), cut("q", F.lit(0)).alias("q1"), cut("r", back).alias("s2"), cut("q", back).alias("q2"),
        )

    @property
    def frags(self) -> DataFrame:
        """Paired fragments; the read is named by its bases, so copies of a passage share a read.

        Every third document is read from the other strand, every fifth tile is single end.
        """
        t = self.tiles
        single = F.col("p") % 200 == 160
        back = F.col("tid") % 3 == 2
        name = F.md5(F.concat_ws("|", "s1", "s2"))
        f1 = F.when(single, F.when(back, 16).otherwise(0)).otherwise(F.lit(1 + 2 + 64) + F.when(back, 16).otherwise(0))
        f2 = F.lit(1 + 2 + 128) + F.when(back, 0).otherwise(16)

        def mate(flag, pos, s, q):
            return F.struct(
                name.alias("qname"), flag.cast("int").alias("flag"), F.col("tid").cast("int").alias("tid"), F.col(pos).alias("pos"),
                F.concat(F.col("rl").cast("string"), F.lit("M")).alias("cigar"), F.col(s).alias("seq"), F.col(q).alias("qual"),
            )

        return t.select(
            (F.col("tid").cast("long") * PLACES + F.col("p")).alias("frag_seq"), name.alias("read_id"), mate(f1, "p", "s1", "q1").alias("first"),
            F.when(~single, mate(f2, "p2", "s2", "q2")).alias("second"), (~single).alias("paired"),
        )

    @property
    def gtf_lines(self) -> DataFrame:
        """Events as exon lines: the user is the chromosome, user and type the gene."""
        start = F.floor(F.col("value") * 10).cast("long") + 1
        end = start + 20 + F.col("event_id") % 80
        attr = F.concat(F.lit('gene_id "g'), "user_id", F.lit("_"), "event_type", F.lit('"; transcript_id "t'), "event_id", F.lit('"; gene_name "'), "event_type", F.lit('";'))
        strand = F.when(F.col("user_id") % 2 == 0, "+").otherwise("-")
        return self.table("events").select(
            F.concat_ws("\t", F.concat(F.lit("chr"), F.col("user_id").cast("string")), F.lit("sim"), F.lit("exon"), start.cast("string"), end.cast("string"), F.lit("."), strand, F.lit("."), attr).alias("value")
        )

    @cached_property
    def exons(self) -> DataFrame:
        from readweave.sources.sequence import parse_gtf

        return parse_gtf(self.gtf_lines)

    @property
    def genome(self) -> DataFrame:
        """Documents as chromosomes named without the chr prefix."""
        return self.seqs.select(F.col("tid").cast("string").alias("chromosome"), "seq")


# The same views for the comparison engine.
def _bases(bases: str, text: str = "text") -> str:
    return f"regexp_replace(translate({text}, '{LETTERS}', '{bases}'), '[^ACGT]', 'N', 'g')"


VIEWS: dict[str, str] = {
    "trs": """SELECT s_suppkey AS tid, n_name AS gene, s_name AS transcript, 300 + CAST(floor(abs(s_acctbal)/4) AS INT) AS length,
        CAST(300 + CAST(floor(abs(s_acctbal)/4) AS INT) - 150 AS DOUBLE) AS eff_length FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "samples": """SELECT cond*3+rep AS file_idx, cond, rep, tr, n, CAST(sum(c) AS DOUBLE)/100::DOUBLE AS value FROM (
        SELECT CASE WHEN l_linestatus='F' THEN 0 ELSE 1 END AS cond, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rep,
        l_suppkey AS tr, CAST((year(l_shipdate)-1995)*12+month(l_shipdate)-1 AS BIGINT) AS n, CAST(round(l_extendedprice*100) AS BIGINT) AS c FROM lineitem) GROUP BY cond, rep, tr, n""",
    "theta": "SELECT file_idx, tr, n, value / sum(value) OVER (PARTITION BY file_idx, n) AS value FROM samples",
    "chains": "SELECT file_idx AS chain, tr, n, value / (sum(value) OVER (PARTITION BY file_idx, n) + 1) AS theta FROM samples",
    "curve": """SELECT ln(k*10000::DOUBLE+5000) AS expr, 1::DOUBLE+c/1000::DOUBLE AS alpha, 0.5::DOUBLE+k*0.1::DOUBLE AS beta FROM (
        SELECT CAST(floor(o_totalprice/10000) AS BIGINT) AS k, count(*) AS c FROM orders GROUP BY 1)""",
    "parts": """SELECT p_partkey AS tid, p_brand||'.'||p_type AS gene, translate(p_name,' ','_')||'-'||p_partkey AS transcript, 300+20*p_size AS length,
        CAST(150+20*p_size AS DOUBLE) AS eff_length FROM part""",
    "raw_hits": "SELECT l_orderkey AS read_id, l_partkey+1 AS tr_id, -l_quantity/5::DOUBLE AS lprob FROM lineitem",
    "hits": "SELECT * FROM raw_hits UNION ALL SELECT read_id, CAST(0 AS BIGINT), min(lprob)-6::DOUBLE FROM raw_hits GROUP BY read_id",
    "merged": "SELECT read_id, tr_id, max(m) + ln(sum(exp(lprob-m))) AS lprob FROM (SELECT *, max(lprob) OVER (PARTITION BY read_id, tr_id) AS m FROM hits) GROUP BY read_id, tr_id",
    "probs": "SELECT read_id, tr_id, lprob, exp(lprob-m)/sum(exp(lprob-m)) OVER (PARTITION BY read_id) AS prob FROM (SELECT *, max(lprob) OVER (PARTITION BY read_id) AS m FROM merged)",
    "seqs": f"SELECT doc_id AS tid, 'doc'||doc_id AS name, source AS gene, {_bases(REF_BASES)} AS seq FROM documents",
    "padded": "SELECT tid, repeat('N',40)||seq||repeat('N',40) AS seq FROM seqs",
    "cuts": "SELECT tid, blk, substring(seq, blk*64+1, 87) AS piece FROM (SELECT tid, seq, unnest(range(n//64+1)) AS blk FROM (SELECT tid, seq, length(seq) AS n FROM padded))",
    "doc_trs": "SELECT doc_id AS tid, source AS gene, 'doc'||doc_id AS transcript, length(text) AS length, CAST(length(text) AS DOUBLE) AS eff_length FROM documents",
    "folded": f"""SELECT doc_id AS tid, {_bases(READ_BASES)} AS r, regexp_replace(translate(text, '{LETTERS}', '{QUALITIES}'), '[^5?FHI]', '8', 'g') AS q, length(text) AS tr_len FROM documents WHERE length(text) > 0""",
    "tiles": f"""SELECT tid, p, flen, rl, tr_len, p+flen-rl AS p2, substring(r, p+1, rl) AS s1, substring(q, p+1, rl) AS q1, substring(r, p+flen-rl+1, rl) AS s2, substring(q, p+flen-rl+1, rl) AS q2
        FROM (SELECT *, least({READ_LENGTH}, flen) AS rl FROM (SELECT *, least(60 + (p//{TILE} + tid*7) % 41, tr_len-p) AS flen FROM (
        SELECT *, unnest(range(0, tr_len, {TILE})) AS p FROM folded)))""",
    "frags": """SELECT *, md5(s1||'|'||s2) AS read_id, p % 200 <> 160 AS paired, tid % 3 = 2 AS back FROM tiles""",
    "reads": "SELECT *, count(*) OVER (PARTITION BY read_id) AS copies FROM frags",
    "uniq": "SELECT *, CAST(CASE WHEN paired THEN flen ELSE rl END AS BIGINT) AS frag_len FROM reads WHERE copies = 1",
    "ends": """SELECT tid, tr_len, frag_len, 5 AS mate, CAST(p AS BIGINT) AS pos FROM uniq WHERE NOT (paired AND back) AND (paired OR NOT back)
        UNION ALL SELECT tid, tr_len, frag_len, 3, CAST(CASE WHEN paired THEN p2+rl ELSE p+rl END AS BIGINT) FROM uniq WHERE NOT (paired AND back) AND (paired OR back)""",
    "exons": """SELECT 'chr'||user_id AS seqname, 'sim' AS source, 'exon' AS feature, CAST(floor(value*10) AS BIGINT)+1 AS start, CAST(floor(value*10) AS BIGINT)+21+event_id%80 AS "end",
        0::DOUBLE AS score, CASE WHEN user_id%2=0 THEN '+' ELSE '-' END AS strand, '.' AS frame,
        'gene_id "g'||user_id||'_'||event_type||'"; transcript_id "t'||event_id||'"; gene_name "'||event_type||'";' AS attribute, 'g'||user_id||'_'||event_type AS gene_id FROM events""",
}


# computed once per query there
STORED = {"folded", "seqs", "padded", "cuts", "frags", "uniq"}


def with_views(sql: str) -> str:
    """Prefix a query with the views it uses, directly or not."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    parts = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in STORED else ''}({body})" for name, body in VIEWS.items() if name in needed)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if not parts:
        return sql
    if own:
        return f"WITH {own.group(1) or ''}{parts},\n{sql[own.end():]}"
    return f"WITH {parts}\n{sql}"
