"""Small hand-made transactions."""

from datetime import datetime, timedelta

T0 = datetime(2024, 3, 4, 10, 0, 0)
COLUMNS = ("transaction_id string, timestamp timestamp, sender_account string, receiver_account string, sender_bank string, "
           "receiver_bank string, sender_country string, receiver_country string, amount double, transaction_type string, "
           "payment_channel string, device_id string, ip_address string, geo_latitude double, geo_longitude double, "
           "transaction_status string, kyc_level int")


def tx(i, at=0.0, s="A", r="B", amount=100.0, **kw):
    """Row number i, ``at`` seconds after the start."""
    row = dict(transaction_id=f"T{i:05d}", timestamp=T0 + timedelta(seconds=at), sender_account=s, receiver_account=r,
               sender_bank="B1", receiver_bank="B2", sender_country="IN", receiver_country="IN", amount=float(amount),
               transaction_type="NEFT", payment_channel="Web", device_id="D1", ip_address="10.0.0.1", geo_latitude=19.0,
               geo_longitude=72.8, transaction_status="Success", kyc_level=2)
    row.update(kw)
    return row


def frame(spark, rows):
    names = [c.strip().split()[0] for c in COLUMNS.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS)


def edge_frame(spark, pairs):
    """Edges one second apart, in the given order."""
    rows = [(a, b, f"E{i:04d}", T0 + timedelta(seconds=i), float(10 * (i + 1)), False) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "src string, dst string, transaction_id string, timestamp timestamp, amount double, is_fraud boolean")
