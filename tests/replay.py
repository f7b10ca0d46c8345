"""Row-by-row replay of an order import, the brute-force model for the merges."""

KEPT = ("vhsys", "type_of_load", "piv", "pid", "siv", "sid")


def replay(orders, items, deliveries, update):
    """``orders``: id -> fields, ``items``: list of dicts; both are changed in place."""
    counts = {"inserted": 0, "updated": 0, "skipped": 0}
    for delivery in sorted(deliveries, key=lambda d: d["arrival"]):
        key = delivery["platform_order_id"]
        known = orders.get(key)
        if known is None:
            orders[key] = {k: v for k, v in delivery.items() if k not in ("arrival", "items")}
            items.extend({**item, "platform_order_id": key} for item in delivery["items"])
            counts["inserted"] += 1
        elif update:
            known["platform_status"], known["total"] = delivery["platform_status"], delivery["total"]
            for name in KEPT:
                if delivery[name] is not None:
                    known[name] = delivery[name]
            for item in delivery["items"]:
                for row in items:
                    same = (
                        row["platform_order_id"] == key
                        and item["platform_item_id"] is not None
                        and row["platform_item_id"] == item["platform_item_id"]
                    )
                    if same:
                        for name in ("nfe_bling_id", "sale_order_bling_id"):
                            if item[name] is not None:
                                row[name] = item[name]
            counts["updated"] += 1
        else:
            counts["skipped"] += 1
    return counts
