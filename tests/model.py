"""A record-at-a-time model of the reference's eight join handlers and its
running sum, in plain Python: the brute-force oracle for small feeds."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from decimal import Decimal


def parse(line: str):
    op, tag, body = line[0], line[1:3], line[3:]
    f = body.split("|")
    ins = op == "+"
    seq = int(f[-1])
    if tag == "LI":
        return ins, tag, seq, dict(okey=int(f[0]), line=int(f[3]), price=Decimal(f[5]),
                                   disc=Decimal(f[6]), ship=dt.date.fromisoformat(f[10]))
    if tag == "OR":
        return ins, tag, seq, dict(okey=int(f[0]), ckey=int(f[1]),
                                   odate=dt.date.fromisoformat(f[4]), prio=int(f[7]))
    if tag == "CU":
        return ins, tag, seq, dict(ckey=int(f[0]), seg=f[6])
    return None


def run(lines: list[str], date: str = "1995-03-13", segment: str = "AUTOMOBILE"):
    """Changelog rows (seq, okey, line, odate, prio, revenue, n) in emission order,
    processing the records in seq order."""
    d = dt.date.fromisoformat(date)
    recs = [r for r in (parse(x) for x in lines) if r is not None]
    recs.sort(key=lambda r: r[2])
    orders_by_cust = defaultdict(dict)  # ckey -> {okey: (odate, prio)}
    cust_alive = {}
    items = defaultdict(dict)  # okey -> {line: (price, disc)}
    order_alive = {}  # okey -> (odate, prio)
    total = defaultdict(lambda: [Decimal(0), 0])
    out = []

    def emit(seq, okey, line, odate, prio, w, price, disc):
        t = total[okey]
        t[0] += w * price * (1 - disc)
        t[1] += w
        out.append((seq, okey, line, odate, prio, float(t[0]), t[1]))

    def j2_child(seq, ins, okey, odate, prio):
        if ins:
            order_alive[okey] = (odate, prio)
        else:
            order_alive.pop(okey, None)
        for line, (price, disc) in sorted(items[okey].items()):
            emit(seq, okey, line, odate, prio, 1 if ins else -1, price, disc)

    for ins, tag, seq, r in recs:
        if tag == "LI":
            if not r["ship"] > d:
                continue
            okey = r["okey"]
            if ins:
                items[okey][r["line"]] = (r["price"], r["disc"])
            else:
                items[okey].pop(r["line"], None)
            if okey in order_alive:
                odate, prio = order_alive[okey]
                emit(seq, okey, r["line"], odate, prio, 1 if ins else -1, r["price"], r["disc"])
        elif tag == "OR":
            if not r["odate"] < d:
                continue
            ck = r["ckey"]
            if ins:
                orders_by_cust[ck][r["okey"]] = (r["odate"], r["prio"])
            else:
                orders_by_cust[ck].pop(r["okey"], None)
            if cust_alive.get(ck):
                j2_child(seq, ins, r["okey"], r["odate"], r["prio"])
        else:
            if r["seg"] != segment:
                continue
            ck = r["ckey"]
            if ins:
                cust_alive[ck] = True
            else:
                cust_alive.pop(ck, None)
            for okey, (odate, prio) in sorted(orders_by_cust[ck].items()):
                j2_child(seq, ins, okey, odate, prio)
    return out


def final_view(changelog_rows):
    """Latest value per order key; live groups only (n > 0)."""
    last = {}
    for row in changelog_rows:
        last[row[1]] = row
    return sorted((k, r[3], r[4], round(r[5], 4), r[6]) for k, r in last.items() if r[6] > 0)
