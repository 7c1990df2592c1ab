"""Compare a query's rows with its SQL's, whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def same(rows, expected) -> None:
    columns = sorted(rows.columns)
    assert sorted(expected.columns) == columns

    def plain(frame):
        frame = frame[columns].copy()
        for c in columns:
            if frame[c].dtype.kind == "f":
                frame[c] = frame[c].map(lambda v: "~" if v != v else f"{v:.6f}")
            else:
                frame[c] = frame[c].astype(object).where(frame[c].notna(), "~").astype(str)
        return frame.sort_values(columns).reset_index(drop=True)

    a, b = plain(rows), plain(expected)
    assert len(a) == len(b)
    different = (a != b).any(axis=1)
    assert not different.any(), (a[different].head().to_string(), b[different].head().to_string())
