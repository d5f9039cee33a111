"""loomcast: preparation, validation and forecasting of large panels of time series on Spark.

A *panel* is a long DataFrame ``(key columns, idx, n, value columns)``: one row per
series and calendar position, ``idx`` counting from 0 and ``n`` the series length.
Every operator is a lazy DataFrame-to-DataFrame function.
"""
