"""Small hand-written inputs."""

TAPE_HEADER = ("timestamp,date,commodity,contract,strike,call_bid,call_offer,call_last,call_vol,call_vol_delta,"
               "call_block,call_block_delta,call_oi,put_bid,put_offer,put_last,put_vol,put_vol_delta,put_block,"
               "put_block_delta,put_oi,futures_last,futures_mid,atm_strike,trade_flag").split(",")


def tape_row(ts, contract, call, put, strike=75):
    row = dict.fromkeys(TAPE_HEADER, "")
    row.update(timestamp=ts, date=ts[:10], commodity="CT", contract=contract, strike=str(strike),
               call_vol=str(call), put_vol=str(put))
    return row


def write_csv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [",".join(header)]
    lines += [",".join(str(r.get(c, "")) for c in header) if isinstance(r, dict) else ",".join(map(str, r)) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def write_tape(root, session, rows, header=TAPE_HEADER, commodity="ct"):
    return write_csv(root / session / f"{commodity}_options_tape.csv", header, rows)


SIDECAR_HEADER = ["timestamp", "date", "commodity", "contract", "boundary", "volume", "oi"]


def boundary_rows(session, contract, v_open=None, v_mid=None, v_end=None):
    return [dict(timestamp="t", date=session, commodity="CT", contract=contract, boundary=b, volume=v, oi=1)
            for b, v in (("open", v_open), ("0700", v_mid), ("1420", v_end)) if v is not None]


def write_sidecar(root, session, rows, header=SIDECAR_HEADER):
    return write_csv(root / session / "ct_futures_volume.csv", header, rows)


def tape_df(spark, rows):
    """(ts, contract, call, put) tuples of session = date of the last character group."""
    data = [(s, ts, c, 75.0, float(call), float(put)) for s, ts, c, call, put in rows]
    return spark.createDataFrame(
        data, "session_date string, snap_ts string, contract string, strike double, call_vol double, put_vol double"
    ).selectExpr("cast(session_date as date) session_date", "cast(snap_ts as timestamp_ntz) snap_ts", "contract",
                 "strike", "call_vol", "put_vol")


def readings_df(spark, rows):
    """(session, contract, boundary, volume) tuples in file order."""
    data = [(s, c, b, None if v is None else float(v), i) for i, (s, c, b, v) in enumerate(rows)]
    return spark.createDataFrame(
        data, "session_date string, contract string, boundary string, volume double, seq int"
    ).selectExpr("cast(session_date as date) session_date", "contract", "boundary", "volume", "seq")


def bars_df(spark, rows):
    data = [(d, g, None if v is None else float(v)) for d, g, v in rows]
    return spark.createDataFrame(data, "session_date string, generic string, volume double").selectExpr(
        "cast(session_date as date) session_date", "generic", "volume")


SEED = [("2026-06-15", "CTDEC1", 30000), ("2026-06-15", "CTMAR1", 8000), ("2026-06-15", "CTJUL1", None),
        ("2026-06-15", "CTOCT1", 999), ("2026-06-16", "CTDEC1", 34000), ("2026-06-16", "CTMAR1", 10000),
        ("2026-06-17", "CTDEC1", 33926), ("2026-06-17", "CTMAR1", 10204), ("2026-06-17", "CTJUL1", 7673)]
