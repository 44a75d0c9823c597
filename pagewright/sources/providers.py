"""Hooks for what is not bundled: text recognition, rasterising, fetching, caption models.

A provider is a function of one row's values that returns a dict of results. It runs in one Arrow stage, over the rows that need it
only; an exception becomes a row with ``failed`` and the reason, and no run ends by it. A limit of time is the provider's own
business: it raises ``TimeoutError``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.captions import caption_gate

#: Longest side to which an image is brought before a caption model sees it, by the provider.
CAPTION_SIDE = 1024


def provide(rows: DataFrame, provider: Callable[..., dict], needs: list[str], gives: str, keep: list[str]) -> DataFrame:
    """``keep``, the provider's results (``gives``, a schema), ``timed_out``, ``failed`` and ``failure``; called with the columns ``needs``."""
    names = [part.split()[0] for part in gives.split(", ")]

    def run(parts):
        import pandas as pd

        for part in parts:
            out = []
            for values in part[needs].itertuples(index=False, name=None):
                try:
                    found = provider(*values)
                    out.append([*(found.get(n) for n in names), False, False, None])
                except TimeoutError as error:
                    out.append([*[None] * len(names), True, False, str(error)])
                except Exception as error:  # a provider's failure is a row's failure
                    out.append([*[None] * len(names), False, True, f"{type(error).__name__}: {error}"])
            yield pd.concat([part[keep].reset_index(drop=True), pd.DataFrame(out, columns=[*names, "timed_out", "failed", "failure"], dtype=object)], axis=1)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), gives, "timed_out boolean, failed boolean, failure string"])
    return rows.select(*dict.fromkeys([*keep, *needs])).mapInPandas(run, schema)


def captions_from(pages: DataFrame, provider: Callable[[bytes], dict]) -> DataFrame:
    """What a caption model says (``explanation``) of the pages on which it is asked at all; needs doc_id, page_number, ocr, hw and data."""
    asked = pages.where(caption_gate(F.col("ocr"), F.col("hw")))
    return provide(asked, provider, ["data"], "explanation string", ["doc_id", "page_number"])


def downloads_from(urls: DataFrame, provider: Callable[[str], dict]) -> DataFrame:
    """The relation of downloads that ``files.with_download_errors`` judges; needs url and filename."""
    got = provide(urls, provider, ["url"], "status int, reason string, content_type string, content_length long, content binary", ["url", "filename"])
    failure = F.when(F.col("timed_out"), "timeout").when(F.col("failure").startswith("ConnectionError"), "connection").otherwise(F.col("failure"))
    return got.withColumns({"failure": failure, "length": F.length("content")}).drop("timed_out", "failed")
