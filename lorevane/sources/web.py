"""Pages and files from the web, through a getter that the caller supplies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fetch(urls: DataFrame, getter: Callable[[str], tuple[int, bytes]], url: str = "full_url", pause: float = 0.0) -> DataFrame:
    """urls with status, content, error. A url that cannot be fetched has its error and no status; others go on.

    getter(url) gives (status, body); it should verify certificates and set time limits. pause: seconds between urls of
    one task.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields) + ", status int, content binary, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for u in frame[url]:
                try:
                    status, body = getter(u)
                    got.append((status, body, None))
                except Exception as e:  # noqa: BLE001  one url must not stop the others
                    got.append((None, None, f"{type(e).__name__}: {e}"))
                if pause:
                    time.sleep(pause)
            frame = frame.copy()
            frame["status"], frame["content"], frame["error"] = (pd.Series([g[k] for g in got], index=frame.index, dtype=object) for k in range(3))
            yield frame

    return urls.mapInPandas(run, schema)


def decoded(pages: DataFrame) -> DataFrame:
    """Fetched pages with html: the body of a 2xx answer as UTF-8; other pages are left out."""
    return pages.where("status BETWEEN 200 AND 299").selectExpr("*", "decode(content, 'UTF-8') AS html")
