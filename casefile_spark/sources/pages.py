"""Page triage: which text stands for a page, and which pages stay unreadable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.generate import inline_rows
from ..functions.text import strip

# Fixed value: share of near-white pixels from which a page counts as blank.
BLANK_SHARE = 0.99


def triage_pages(page_text: DataFrame) -> DataFrame:
    """Native text first, else OCR text; otherwise blank or unreadable.

    page_text: file_id, page_no, native_text, ocr_text, near_white. A NULL ``near_white`` means the
    page could not be rendered. Adds text, status (native, ocr, blank, unreadable).
    """
    page_text = page_text.withColumns(
        {"_n": strip(F.coalesce("native_text", F.lit(""))), "_o": strip(F.coalesce("ocr_text", F.lit("")))}
    )
    native, ocr = F.col("_n"), F.col("_o")
    status = (
        F.when(native != "", "native")
        .when(ocr != "", "ocr")
        .when(F.coalesce(F.col("near_white"), F.lit(0.0)) >= BLANK_SHARE, "blank")
        .otherwise("unreadable")
    )
    text = F.when(native != "", native).when(ocr != "", ocr)
    return page_text.select("file_id", "page_no", text.alias("text"), status.alias("status"))


def readable_pages(triaged: DataFrame) -> DataFrame:
    # Through a generator, so that the page text is not computed a second time to test it.
    page = F.array(F.struct("text", (F.col("status") == "ocr").alias("is_ocr")))
    return inline_rows(triaged, ["file_id", "page_no"], page, "text")


def page_report(triaged: DataFrame) -> DataFrame:
    """Per file: pages that came from OCR and pages nobody could read, in page order."""
    def numbers(status: str):
        return F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("page_no"))))

    return triaged.groupBy("file_id").agg(
        numbers("ocr").alias("ocr_pages"), numbers("unreadable").alias("unreadable_pages")
    )
