import pandas as pd


def frame(df, *sort):
    """Collected rows as pandas, sorted for comparison."""
    out = df.toPandas()
    return out.sort_values(list(sort) or list(out.columns)).reset_index(drop=True)


def same(left, right, *sort):
    pd.testing.assert_frame_equal(
        frame(left, *sort), frame(right, *sort), check_like=True, rtol=1e-9)
