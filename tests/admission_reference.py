"""One-request-at-a-time admission, for comparison with the batch and the stream."""


def admit_reference(requests: list[dict], existing: list[dict], category_of: dict) -> dict:
    """Brute-force sequential admission for tests (one request at a time,
    exactly as the reference's locked transactions would)."""
    accepted = [dict(e) for e in existing if e["status"] in ("ACTIVE", "SCHEDULED")]
    out = {}
    for r in sorted(requests, key=lambda x: (x["arrival"], x["id"])):
        def applies(e):
            if r["scope"] == "CATEGORY":
                return e["scope"] == "CATEGORY" and e["target_category_id"] == r["target_category_id"]
            if e["scope"] == "PRODUCT":
                return e["target_product_id"] == r["target_product_id"]
            return e["target_category_id"] == category_of.get(r["target_product_id"])
        hit = any(applies(e) and e["starts_at"] < r["ends_at"] and r["starts_at"] < e["ends_at"]
                  for e in accepted)
        out[r["id"]] = not hit
        if not hit:
            accepted.append(r)
    return out
