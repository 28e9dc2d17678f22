"""Services over HTTP, landed files, and what runs after a load."""

from __future__ import annotations

import functools
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PdfService:
    """A client of a PDF-to-TEI service: one request a PDF, again after a pause while the service is busy (503).

    send(url, body, headers, timeout) gives (status, text); it can be replaced in tests. Answers other than 200 are no text;
    a timeout is status 408.
    """

    def __init__(self, url: str, timeout: int = 180, pause: float = 5, tries: int = 20, path: str = "/api/processFulltextDocument", send: Callable | None = None):
        self.url, self.timeout, self.pause, self.tries, self.path = url.rstrip("/"), timeout, pause, tries, path
        self.send = send or _send

    def ask(self, pdf: bytes) -> tuple[int, str | None]:
        """(status, TEI or None)."""
        mark = uuid.uuid4().hex
        body = f'--{mark}\r\nContent-Disposition: form-data; name="input"; filename="a.pdf"\r\nContent-Type: application/pdf\r\n\r\n'.encode() + pdf + f"\r\n--{mark}--\r\n".encode()
        for k in range(self.tries):
            try:
                status, text = self.send(self.url + self.path, body, {"Content-Type": f"multipart/form-data; boundary={mark}", "Accept": "text/plain"}, self.timeout)
            except TimeoutError:
                return 408, None
            if status != 503:
                return status, text if status == 200 else None
            if k + 1 < self.tries:
                time.sleep(self.pause)
        return 503, None

    def process(self, pdf: bytes) -> str | None:
        return self.ask(pdf)[1]

    def alive(self) -> bool:
        try:
            return self.send(f"{self.url}/api/isalive", None, {}, self.timeout)[0] == 200
        except (TimeoutError, OSError):
            return False


def _send(url: str, body: bytes | None, headers: dict, timeout: int) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers), timeout=timeout) as r:  # noqa: S310
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            raise e.reason from e
        raise


def export_tei(documents: DataFrame, path: str, name: str = "name", tei: str = "tei") -> None:
    """A folder for each name with its TEI; documents without TEI are left out."""
    documents.filter(F.col(tei).isNotNull()).select(name, F.col(tei).alias("value")).write.mode("overwrite").partitionBy(name).text(path)


def files_by_time(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes), the oldest first, then by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy("modified", "path")


def rows_by_file(df: DataFrame) -> DataFrame:
    """(file, n): how many rows each file of a table gave."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))


def then(after: Callable) -> Callable:
    """A decorator: after(result) runs once the load has ended well; its result isn't used."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **kwargs):
            out = f(*args, **kwargs)
            after(out)
            return out

        return run

    return wrap
