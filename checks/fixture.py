"""A dirty invoice table derived from ``orders``, as SQL both engines run."""

INVOICES = """
SELECT
  o_orderkey AS invoice_id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL
       ELSE concat('INV-', CAST(o_orderkey - CASE WHEN o_orderkey % 41 = 0 AND o_orderkey > 0
                                                  THEN 1 ELSE 0 END AS VARCHAR(20))) END AS invoice_number,
  CASE o_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN '  kpmg   advisory '
       WHEN 3 THEN 'UNKNOWN VENDOR' WHEN 4 THEN 'usb-c hub LTD'
       ELSE concat('Vendor ', CAST(o_custkey % 50 AS VARCHAR(20))) END AS vendor_name,
  CASE WHEN o_orderkey % 13 = 0 THEN 'bad-date' WHEN o_orderkey % 17 = 0 THEN NULL
       WHEN o_orderkey % 19 = 0 THEN concat(substr(CAST(o_orderdate AS VARCHAR(30)),9,2), '/',
            substr(CAST(o_orderdate AS VARCHAR(30)),6,2), '/', substr(CAST(o_orderdate AS VARCHAR(30)),1,4))
       ELSE substr(CAST(o_orderdate AS VARCHAR(30)),1,10) END AS invoice_date,
  CASE WHEN o_orderkey % 9 = 0 THEN '1990-01-01' ELSE '2005-06-30' END AS due_date,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '2006-01-15' END AS payment_date,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN -o_totalprice
       WHEN o_orderkey % 101 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS amount,
  CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 10) AS DOUBLE) END AS tax_amount,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN o_totalprice + 5.0
       ELSE o_totalprice + CAST(floor(o_totalprice / 10) AS DOUBLE) END AS total_amount,
  CASE o_custkey % 7 WHEN 0 THEN 'usd' WHEN 1 THEN ' Eur ' WHEN 2 THEN 'XYZ' WHEN 3 THEN NULL
       ELSE 'USD' END AS currency,
  CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN '  Pending  ' ELSE 'settled' END AS status
FROM orders
"""
