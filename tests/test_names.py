from pyspark.sql import functions as F

from brookmill.functions.names import entity, window_name

CASES = {
    "dcbmtvjbbz_3682_4018": ("dcbmtvjbbz", None, 3682, 4018), "dcbmtvjbbz 3682 4018": ("dcbmtvjbbz", None, 3682, 4018), "drivecam:dcb9jtkbbf:1676:2071": ("dcb9jtkbbf", None, 1676, 2071),
    "shelfsales/ss7h69pbbn_2572_2682": ("ss7h69pbbn", None, 2572, 2682), "abdgqt9bbr_004420_004688": ("abdgqt9bbr", None, 4420, 4688), "Ssh8h58bbw_f2000_f2381": ("ssh8h58bbw", None, 2000, 2381),
    "wmfhhtmbbr%5F3986%5F4270": ("wmfhhtmbbr", None, 3986, 4270), "pthp24kbbq–1123–1430": ("pthp24kbbq", None, 1123, 1430), "LVJNDF8BBV_4411_4594__CH05": ("lvjndf8bbv", 5, 4411, 4594),
    "lvcrgbtbbd 336 652 ch 3": ("lvcrgbtbbd", 3, 336, 652), " lvchmnsbbw__2879__3017__ch02": ("lvchmnsbbw", 2, 2879, 3017), "lvcd7g2bbr_3360_3590__ch4 (1)": ("lvcd7g2bbr", 4, 3360, 3590),
    "dcs76m3bbj_231_590.v2": ("dcs76m3bbj", None, 231, 590), "data\\drive\\clips\\dcqfjfcbbc_3078_3361.mp4": ("dcqfjfcbbc", None, 3078, 3361),
    "data/drive/timeseries/../timeseries/dcxqqdpbbx_9574_9777.csv": ("dcxqqdpbbx", None, 9574, 9777), "data/land/timeseries/lvjkrz3bbj_1848_1964__ch4.target.csv": ("lvjkrz3bbj", 4, 1848, 1964),
    "ｄｃｂｍｔｖｊｂｂｚ＿１２＿３４": ("dcbmtvjbbz", None, 12, 34), "dcbmtvjbbz_0_9": ("dcbmtvjbbz", None, 0, 9), "row-8084aed1087e": None, "": None, "   ": None, "dcbmtvjbbz_9_3": None, "100%": None,
    "x" * 20000: None, None: None,
}


def test_names(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "s string").select("s", window_name(F.col("s")).alias("n"), entity(F.col("s")).alias("e"))
    for r in df.collect():
        want = CASES[r["s"]]
        assert (tuple(r["n"]) if r["n"] else None) == want, r["s"]
        if want:
            assert r["e"] == want[0]


def test_shared_tables_are_released(spark):
    import os

    import brookmill.session as session

    t = session.SharedTable(spark.range(3), "x")
    path = t.path.removeprefix("file://")
    assert t.read().count() == 3 and os.path.isdir(path)
    session.release()
    assert not os.path.exists(path) and not session._MADE
