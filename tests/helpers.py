import datetime as dt

from pyspark.sql import types as T

D = dt.date


def weather_df(spark, rows):
    """rows: (station_id, 'yyyyMMdd', tavg_raw)"""
    schema = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("ymd", T.StringType()),
                           T.StructField("tavg_raw", T.StringType())])
    return spark.createDataFrame(rows, schema)


def inv_station_df(spark, rows):
    """rows: (account_id, zip, from_dt, to_dt, kwh, station_id, station_dist)"""
    schema = T.StructType([T.StructField("account_id", T.LongType()), T.StructField("zip", T.IntegerType()),
                           T.StructField("from_dt", T.DateType()), T.StructField("to_dt", T.DateType()),
                           T.StructField("kwh", T.IntegerType()), T.StructField("station_id", T.StringType()),
                           T.StructField("station_dist", T.DecimalType(4, 2))])
    return spark.createDataFrame(rows, schema)


def inv_pair_df(spark, rows):
    """rows: (account_id, zip, from_dt, to_dt, kwh, station_id_1, station_dist_1, station_id_2, station_dist_2)"""
    schema = T.StructType([T.StructField("account_id", T.LongType()), T.StructField("zip", T.IntegerType()),
                           T.StructField("from_dt", T.DateType()), T.StructField("to_dt", T.DateType()),
                           T.StructField("kwh", T.IntegerType()),
                           T.StructField("station_id_1", T.StringType()), T.StructField("station_dist_1", T.DecimalType(4, 2)),
                           T.StructField("station_id_2", T.StringType()), T.StructField("station_dist_2", T.DecimalType(4, 2))])
    return spark.createDataFrame(rows, schema)
