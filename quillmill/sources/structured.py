"""Sources of nested records: arXiv JSON lines, Elsevier JSON files, TEI XML, full-text sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.authors import year_in

ARXIV = "id string, authors_parsed array<array<string>>, title string, abstract string, doi string, `journal-ref` string, versions array<struct<created:string>>, categories string, comments string"
ELSEVIER = "abstract string, author_highlights array<struct<sentence:string>>, body_text array<struct<title:string,sentence:string>>, metadata struct<asjc:array<string>,doi:string,title:string,authors:array<struct<first:string,last:string>>,keywords:array<string>,issn:string,pub_year:string>"
#: Archives of the preprint server and their names.
ARCHIVES = {"cs": "Computer Science", "econ": "Economics", "eess": "Electrical Engineering and Systems Science", "math": "Mathematics", "astro-ph": "Astrophysics", "cond-mat": "Condensed Matter", "gr-qc": "General Relativity and Quantum Cosmology", "hep-ex": "High Energy Physics - Experiment", "hep-lat": "High Energy Physics - Lattice", "hep-ph": "High Energy Physics - Phenomenology", "hep-th": "High Energy Physics - Theory", "math-ph": "Mathematical Physics", "nlin": "Nonlinear Sciences", "nucl-ex": "Nuclear Experiment", "nucl-th": "Nuclear Theory", "physics": "Physics", "quant-ph": "Quantum Physics", "q-bio": "Quantitative Biology", "q-fin": "Quantitative Finance", "stat": "Statistics"}
#: Subject code ranges of each field.
FIELD_CODES = {"Chemistry": ["1500-1508", "1600-1606"], "Artificial Intelligence": ["1702", "1707", "1711"], "Life and Health Science": ["1100-1111", "1502", "1300-1315", "1911", "2204", "2307", "2400-2406", "2700-2748", "2800-2809", "2900-2923", "3000-3005", "3400-3404", "3500-3506", "3600-3616"], "Environmental Science and Renewable Energy": ["1900-1910", "1913", "2103", "2105", "2300-2306", "2312", "2309-2312"], "Material Science": ["2211", "2500-2508"], "Physics": ["1506", "1507", "3100-3110", "1607", "2100-2102", "2104"], "Mathematics": ["1703", "2600-2614"], "Social Sciences": ["1200-1213", "1400-1410", "1800-1804", "2000-2003", "2308", "3200-3207", "3300-3322"], "Computer Science": ["1700-1712"], "Engineering": ["1500-1502", "1909", "2102", "2104", "2200-2216", "1711", "1603"], "Economics and Finance": ["1804", "2000-2003"], "Multidisciplinary": ["1000"]}


def read_arxiv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARXIV).json(path)


def arxiv_papers(raw: DataFrame, category: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """(doi, Authors, year, fields, Abstract, Title, Journal) of records that weren't withdrawn; names: (category, name)."""
    df = raw.filter(F.col("comments").isNull() | ~F.lower("comments").contains("withdrawn"))
    if category:
        df = df.filter(F.col("categories") == category)
    archive = F.split(F.split("categories", " ")[0], r"\.")[0]
    df = df.withColumn("_archive", F.coalesce(F.create_map(*(F.lit(x) for p in ARCHIVES.items() for x in p))[archive], archive)).withColumn("_cat", F.split("categories", " ")[0])
    if names is not None:
        df = df.join(names.select(F.col("category").alias("_cat"), F.col("name").alias("_name")), "_cat", "left")
    else:
        df = df.withColumn("_name", F.lit(None).cast("string"))
    parts = F.transform(F.split("_name", "[-,]"), lambda x: F.trim(x))
    author = lambda a: F.array_join(F.filter(F.reverse(F.slice(a, 1, 2)), lambda x: x != ""), " ")
    return df.select(
        F.coalesce("doi", "id").alias("doi"), F.array_join(F.transform("authors_parsed", author), ", ").alias("Authors"), F.regexp_extract(F.col("versions")[0]["created"], "([0-9]{4})", 1).try_cast("int").alias("year"),
        F.concat(F.array("_archive"), F.coalesce(parts, F.array().cast("array<string>"))).alias("fields"), F.trim(X.one_line("abstract")).alias("Abstract"), X.one_line("title").alias("Title"), F.col("journal-ref").alias("Journal"),
    )


def read_elsevier(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ELSEVIER).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def elsevier_papers(raw: DataFrame, field_ranges: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Papers with the fields of their subject codes; field_ranges: (label, lo, hi), subjects: (code, subject)."""
    from ..operators.intervals import range_labels

    key = F.coalesce(F.col("metadata.doi"), F.col("file"))
    base = raw.withColumn("_key", key)
    codes = base.select("_key", F.explode("metadata.asjc").alias("code")).withColumn("code", F.col("code").try_cast("int"))
    fields = range_labels(codes, "code", field_ranges).select("_key", "label")
    if subjects is not None:
        fields = fields.unionByName(codes.join(subjects, "code").select("_key", F.col("subject").alias("label")))
    fields = fields.groupBy("_key").agg(F.array_sort(F.collect_set("label")).alias("fields"))
    m = F.col("metadata")
    return base.join(fields, "_key", "left").select(
        m["doi"].alias("doi"), F.array_join(F.transform(m["authors"], lambda a: F.concat_ws(" ", a["first"], a["last"])), ", ").alias("Authors"), m["pub_year"].try_cast("int").alias("year"), F.coalesce("fields", F.array().cast("array<string>")).alias("fields"),
        X.one_line("abstract").alias("Abstract"), F.array_join(m["keywords"], ", ").alias("Keywords"), m["title"].alias("Title"), m["issn"].alias("Journal"), F.array_join(F.transform("author_highlights", lambda h: h["sentence"]), " ").alias("highlights"),
    )


def files_with_field(papers: DataFrame, field: str) -> DataFrame:
    return papers.filter(F.array_contains("fields", field))


def tei_papers(docs: DataFrame, xml: str = "tei") -> DataFrame:
    """Papers from TEI documents as PDF services give them; those of five words or fewer in the abstract go."""
    t = F.regexp_replace(F.col(xml), r"""\sxmlns(:\w+)?="[^"]*"|<\?xml[^>]*\?>""", "")
    t = F.regexp_replace(t, r"\bxml:(?=\w+=)", "")
    df = docs.withColumn("_t", t)
    one = lambda path: F.trim(F.xpath_string("_t", F.lit(path)))
    many = lambda path: F.xpath("_t", F.lit(path + "/text()"))
    fore, last = many("//analytic/author[persName/forename and persName/surname]/persName/forename[1]"), many("//analytic/author[persName/forename and persName/surname]/persName/surname")
    out = df.select(
        one("//idno[@type='DOI']").alias("doi"), F.array_join(F.zip_with(fore, last, lambda a, b: F.concat_ws(" ", a, b)), ", ").alias("Authors"), year_in(one("//date[@type='published']")).alias("year"),
        X.one_line(one("//abstract")).alias("Abstract"), F.array_join(F.filter(F.transform(F.split(one("//keywords"), "\n"), lambda x: F.trim(x)), lambda x: x != ""), ", ").alias("Keywords"), one("//title[@type='main']").alias("Title"), one("//title[@level='j']").alias("Journal"),
    )
    return out.filter(X.word_count("Abstract") > 5)


#: The headers that open each part of a paper.
PARTS = (("abstract", "abstract"), ("introduction", "introduction"), ("methods", "methods?"), ("results", "results?|discussion"), ("references", "references|funding|disclosures|acknowledgment"))


def header_parts(headers: Column | str) -> Column:
    """The part that each header of a paper belongs to. A part opens at its header, or at the next but one's; none reopens."""
    names = [n for n, _ in PARTS]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        hit = [F.lower(h).rlike(p) for _, p in PARTS]
        at = acc["at"]
        new = at
        for k in reversed(range(len(PARTS) - 1)):
            far = F.when(hit[k + 2], F.lit(k + 2)).otherwise(F.lit(k)) if k + 2 < len(PARTS) else F.lit(k)
            new = F.when(at == k, F.when(hit[k + 1], F.lit(k + 1)).otherwise(far)).otherwise(new)
        name = F.element_at(F.array(*map(F.lit, names)), new + 1)
        return F.struct(new.cast("int").alias("at"), F.concat(acc["out"], F.array(name)).alias("out"))

    return F.aggregate(X._col(headers), start, step, lambda acc: acc["out"])


def section_texts(sections: Column | str) -> Column:
    """map<part, text> of array<struct<header, paragraphs>>: each part's paragraphs, one header after the other."""
    s = X._col(sections)
    of = header_parts(F.transform(s, lambda x: x["header"]))
    told = F.zip_with(of, s, lambda p, x: F.struct(p.alias("part"), F.array_join(x["paragraphs"], " ").alias("text")))
    names = F.array_distinct(of)
    own = lambda k: F.array_join(F.transform(F.filter(told, lambda x: x["part"] == k), lambda x: x["text"]), " ")
    return F.map_from_arrays(names, F.transform(names, own))


#: Words of abstract headers, by class, in the order in which they are tried.
HEADER_CLASSES = (("background", "introduction|background"), ("objectives", "purpose|aim|objective"), ("methods", "method|materials|approach"), ("results", "result|finding|conclusion"))


def header_class(c: Column | str) -> Column:
    out = None
    for name, pattern in HEADER_CLASSES:
        hit = F.lower(X._col(c)).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def is_structured(headers: Column | str) -> Column:
    """Abstracts whose headers are questions, reviews and the like aren't used."""
    return ~F.exists(X._col(headers), lambda h: F.lower(h).rlike("text|review|question|meaning|finding"))


def grobid(pdfs: DataFrame, client, path: str = "path", content: str = "content", at_once: int = 10) -> DataFrame:
    """(path, status, tei, error) from PDF bytes, at_once requests of a task on their way at a time.

    client: an object, or a class that is made once a task, with ask(bytes) -> (status, tei) or process(bytes) -> tei. A null
    document is asked as no bytes. What fails has no tei: its status is the service's, or 0 with the error's name, so that
    those rows can be found and asked again.
    """
    from concurrent.futures import ThreadPoolExecutor

    import pandas as pd

    def run(batches):
        made = client() if isinstance(client, type) else client

        def one(pdf) -> tuple[int, str | None, str | None]:
            try:
                status, tei = made.ask(pdf or b"") if hasattr(made, "ask") else (200, made.process(pdf or b""))
            except Exception as e:  # one unreadable file must not end the job: its row says so
                return 0, None, type(e).__name__
            return status, tei, None

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                out = list(pool.map(one, b[content]))
                yield pd.DataFrame({"path": b[path], **{c: [r[k] for r in out] for k, c in enumerate(("status", "tei", "error"))}})

    return pdfs.select(path, content).mapInPandas(run, "path string, status int, tei string, error string")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)


def pdf_articles(pages: DataFrame, file: str = "file", page: str = "page", text: str = "text", least_words: int = 20) -> DataFrame:
    """(file, first, last): articles of a file of many start at pages with an abstract; pages: one row a page."""
    from pyspark.sql import Window as W

    starts = pages.filter(F.lower(text).rlike(r"a\s*b\s*s\s*t\s*r\s*a\s*c\s*t")).filter(X.word_count(text) > least_words)
    last = pages.groupBy(file).agg(F.max(page).alias("_last"))
    nxt = F.lead(page).over(W.partitionBy(file).orderBy(page))
    return starts.withColumn("_next", nxt).join(last, file).select(file, F.col(page).alias("first"), F.coalesce(F.col("_next") - 1, "_last").alias("last"))
