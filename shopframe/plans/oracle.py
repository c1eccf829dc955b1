"""DuckDB SQL oracles for the registered queries.

Each oracle starts with the shop-table mapping ``SHOP_CTE`` (the SQL twin of
``sources.shop_tables``) and then states the query independently of the
Spark code, over the same whole tables.
"""

from __future__ import annotations

SHOP_CTE = """
WITH s_users AS (
  SELECT c_custkey AS user_id,
         CASE WHEN c_custkey = 0 THEN 'administrator' ELSE c_name END AS username,
         'User' || c_custkey || '@Example.com' AS email,
         c_acctbal < 0 AS is_disabled, c_mktsegment AS user_type
  FROM customer),
s_categories AS (
  SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS category_id,
         p_brand AS category, false AS is_disabled
  FROM part),
s_products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_type AS description, p_retailprice AS price,
         p_size - 1 AS stock, p_size > 45 AS is_disabled,
         CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS category_id
  FROM part),
s_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, o_totalprice AS total,
         CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'draft'
              WHEN o_orderpriority = '1-URGENT' THEN 'Pending' ELSE 'pending_approval' END AS status,
         o_orderdate AS created_at, o_orderpriority AS description
  FROM orders),
s_order_item AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_item_id,
         l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
         CAST(floor(l_extendedprice * 100 / l_quantity) / 100 AS DECIMAL(18,2)) AS price,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS total
  FROM lineitem),
s_delivery AS (
  SELECT o_orderkey AS delivery_id, o_custkey AS user_id, o_orderkey AS order_id,
         'User' || c_custkey || '@Example.com' AS email, n_name AS country, o_orderpriority AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
s_newsletter AS (
  SELECT c_custkey AS newsletter_id, 'user' || c_custkey || '@example.com' AS email, false AS is_disabled
  FROM customer),
s_testimonial AS (
  SELECT d.doc_id AS customer_testimonial_id, source AS name, text AS comment, quality AS rating
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s_slide_show AS (
  SELECT page_id AS slide_show_id, url AS title, html AS description FROM pages),
s_order_requests AS (
  SELECT DISTINCT user_id AS order_id FROM events),
s_status_changes AS (
  SELECT event_id, ts, user_id AS order_id,
         CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'signup' THEN 'draft'
                         ELSE 'pending_approval' END AS status
  FROM events WHERE event_type IN ('purchase', 'signup', 'click'))
"""

# The tables after deletes that did not cascade, their references and keys.
_AFTER_DELETES = """
, d_orders AS (SELECT * FROM s_orders WHERE order_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')),
d_users AS (SELECT * FROM s_users WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')),
d_products AS (SELECT * FROM s_products WHERE product_id NOT IN (SELECT user_id FROM events WHERE event_type IN ('error', 'signup'))),
refs AS (
  SELECT 'orders' AS child, 'user_id' AS "column", 'users' AS parent, user_id AS key FROM d_orders
  UNION ALL SELECT 'order_item', 'product_id', 'products', product_id FROM s_order_item
  UNION ALL SELECT 'order_item', 'order_id', 'orders', order_id FROM s_order_item
  UNION ALL SELECT 'products', 'category_id', 'categories', category_id FROM d_products
  UNION ALL SELECT 'delivery_details', 'user_id', 'users', user_id FROM s_delivery
  UNION ALL SELECT 'delivery_details', 'order_id', 'orders', order_id FROM s_delivery),
parents AS (
  SELECT 'users' AS parent, user_id AS key FROM d_users
  UNION ALL SELECT 'products', product_id FROM d_products
  UNION ALL SELECT 'orders', order_id FROM d_orders
  UNION ALL SELECT 'categories', category_id FROM s_categories)
"""


def _content(table: str, view: str, columns: str) -> str:
    """Row count and content digest of a table; a column of the export order
    is a name with t (time), m (money) or nothing after a colon, or - if the
    test data has no values for it."""
    parts = []
    for c in columns.split():
        name, _, kind = c.partition(":")
        if name == "-":
            parts.append("'n'")
            continue
        text = {
            "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S')", "m": f"CAST(CAST({name} AS DECIMAL(18,2)) AS VARCHAR)",
        }.get(kind, f"CAST({name} AS VARCHAR)")
        parts.append(f"coalesce(strlen({text}) || ':' || {text}, 'n')")
    row = " || ".join(parts)
    return (
        f"SELECT '{table}' AS t, true AS ok, count(*) AS n, "
        f"CAST(coalesce(sum(CAST(('0x' || substr(md5({row}), 1, 12)) AS BIGINT)), 0) AS VARCHAR) AS digest FROM {view}"
    )


_CONTENT = "\n" + "\nUNION ALL ".join(
    _content(*x) for x in (
        ("orders", "s_orders", "order_id user_id total:m status created_at:t - description"),
        ("order_item", "s_order_item", "product_id quantity price:m - - order_id total:m order_item_id"),
        ("delivery_details", "s_delivery", "delivery_id user_id order_id email country - - - - - - status - - -"),
        ("users", "s_users", "user_id username email - is_disabled - - user_type"),
        ("products", "s_products", "product_id name description price:m stock - is_disabled - - category_id"),
        ("categories", "s_categories", "category_id category is_disabled"),
        ("customer_testimonial", "s_testimonial", "customer_testimonial_id name comment rating - -"),
        ("newsletter", "s_newsletter", "newsletter_id email is_disabled"),
        ("slide_show", "s_slide_show", "title description - slide_show_id"),
    )
)

_BODIES: dict[str, str] = {
    "orders_by_month_status": """
SELECT strftime(created_at, '%B') AS month, status, count(*) AS count
FROM s_orders WHERE year(created_at) = 1998 GROUP BY 1, 2""",
    "monthly_status_dataset": """
SELECT strftime(created_at, '%B') AS month,
       count(*) FILTER (WHERE status = 'paid') AS paid,
       count(*) FILTER (WHERE status = 'pending_approval') AS pending_approval,
       count(*) FILTER (WHERE status = 'draft') AS draft,
       count(*) FILTER (WHERE status = 'Pending') AS Pending
FROM s_orders WHERE year(created_at) = 1998 GROUP BY 1""",
    "orders_view": """
SELECT order_id, o.user_id, username, total, status, description
FROM s_users u JOIN s_orders o ON u.user_id = o.user_id""",
    "order_item_view": """
SELECT order_item_id, i.order_id,
       CASE WHEN o.order_id IS NULL THEN 'No product found' ELSE CAST(i.product_id AS VARCHAR) END AS product_id,
       name, quantity, i.price, i.total, username
FROM s_order_item i JOIN s_products p ON i.product_id = p.product_id
LEFT JOIN s_orders o ON i.order_id = o.order_id
LEFT JOIN s_users u ON o.user_id = u.user_id""",
    "products_view": """
SELECT product_id, name, description, price, stock, CAST(NULL AS VARCHAR) AS images, p.is_disabled, category
FROM s_products p JOIN s_categories c ON p.category_id = c.category_id""",
    "catalog": """
SELECT product_id, name, description, price, stock, CAST(NULL AS VARCHAR) AS images, p.category_id, category
FROM s_products p JOIN s_categories c ON p.category_id = c.category_id WHERE stock > 0""",
    "products_in_category": """
SELECT product_id, name
FROM s_products p JOIN s_categories c ON p.category_id = c.category_id WHERE category = 'Brand#2'""",
    "users_view": """
SELECT user_id, username, email, user_type, is_disabled FROM s_users WHERE username <> 'administrator'""",
    "delivery_view": """
SELECT delivery_id, user_id, order_id, email, country, status,
       CAST(NULL AS VARCHAR) AS f_name, CAST(NULL AS VARCHAR) AS l_name, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS postal_code, CAST(NULL AS VARCHAR) AS phone_number, CAST(NULL AS VARCHAR) AS description
FROM s_delivery""",
    "categories_view": """
SELECT category_id, category, is_disabled FROM s_categories""",
    "testimonial_view": """
SELECT customer_testimonial_id, name, comment, rating, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS avatar FROM s_testimonial""",
    "newsletter_view": """
SELECT newsletter_id, email, is_disabled FROM s_newsletter""",
    "slide_show_view": """
SELECT slide_show_id, title, description, CAST(NULL AS VARCHAR) AS image FROM s_slide_show""",
    "orders_view_by_ids": """
SELECT order_id, username FROM s_orders o JOIN s_users u ON u.user_id = o.user_id
WHERE order_id IN (SELECT order_id FROM s_order_requests)""",
    "order_lines": """
SELECT order_item_id, order_id, product_id, quantity FROM s_order_item
WHERE order_id IN (SELECT order_id FROM s_order_requests)""",
    "login_lookup": """
SELECT user_id FROM s_users
WHERE lower(email) IN (SELECT lower(CASE WHEN event_type IN ('signup', 'purchase')
                                         THEN 'User' || user_id || '@Example.com'
                                         ELSE printf('Customer#%09d', user_id) END) FROM events)
   OR lower(username) IN (SELECT lower(CASE WHEN event_type IN ('signup', 'purchase')
                                            THEN 'User' || user_id || '@Example.com'
                                            ELSE printf('Customer#%09d', user_id) END) FROM events)""",
    "order_subtotals": """
SELECT order_id, CAST(sum(total) AS DOUBLE) AS total FROM s_order_item GROUP BY 1""",
    "next_ids": """
SELECT 'orders' AS t, coalesce(max(order_id), 0) + 1 AS next_id FROM s_orders
UNION ALL SELECT 'users', coalesce(max(user_id), 0) + 1 FROM s_users
UNION ALL SELECT 'delivery_details', coalesce(max(delivery_id), 0) + 1 FROM s_delivery""",
    "next_ids_after_truncate": """
SELECT 'orders' AS t, CAST(1 AS BIGINT) AS next_id, CAST(0 AS BIGINT) AS n
UNION ALL SELECT 'users', coalesce(max(user_id), 0) + 1, count(*) FROM s_users
UNION ALL SELECT 'delivery_details', 1, 0""",
    "latest_draft": """
SELECT user_id, order_id FROM s_orders WHERE status = 'draft'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, order_id DESC) = 1""",
    "first_pending": """
SELECT user_id, order_id FROM s_orders WHERE status = 'Pending'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at, order_id) = 1""",
    "stock_check": """
SELECT r.order_item_id, r.order_id, r.product_id,
       CASE WHEN o.order_id IS NOT NULL AND l.order_item_id IS NOT NULL THEN name END AS p_name,
       CASE WHEN o.order_id IS NOT NULL AND l.order_item_id IS NOT NULL THEN stock END AS quantity,
       CASE WHEN o.order_id IS NULL OR l.order_item_id IS NULL OR p.product_id IS NULL THEN 404
            WHEN l.quantity > stock THEN 422 ELSE 200 END AS code
FROM (SELECT order_item_id, order_id * 2 AS order_id, product_id + quantity AS product_id FROM s_order_item) r
LEFT JOIN s_orders o ON r.order_id = o.order_id
LEFT JOIN (SELECT order_item_id, arg_min(quantity, (order_id, quantity)) AS quantity FROM s_order_item GROUP BY 1) l
  ON r.order_item_id = l.order_item_id
LEFT JOIN s_products p ON r.product_id = p.product_id""",
    "product_demand": """
SELECT product_id, CAST(sum(quantity) AS BIGINT) AS demand
FROM s_order_item i JOIN s_orders o ON i.order_id = o.order_id WHERE status = 'paid' GROUP BY 1""",
    "stock_after_demand": """
SELECT p.product_id,
       CASE WHEN stock - coalesce(d, 0) < 0 THEN stock ELSE stock - coalesce(d, 0) END AS stock,
       CASE WHEN stock - coalesce(d, 0) < 0 THEN 400 ELSE 200 END AS code
FROM s_products p LEFT JOIN (
  SELECT product_id, CAST(sum(quantity) AS BIGINT) AS d
  FROM s_order_item i JOIN s_orders o ON i.order_id = o.order_id WHERE status = 'paid' GROUP BY 1
) USING (product_id)""",
    "stock_sequential": """
SELECT * FROM (
WITH RECURSIVE l AS (
  SELECT i.product_id, order_item_id, quantity, stock,
         row_number() OVER (PARTITION BY i.product_id ORDER BY i.order_id, order_item_id) AS rn
  FROM s_order_item i JOIN s_products p ON i.product_id = p.product_id
  JOIN s_orders o ON i.order_id = o.order_id WHERE status = 'paid'),
r AS (
  SELECT product_id, order_item_id, rn,
         CASE WHEN quantity <= stock THEN stock - quantity ELSE stock END AS rem,
         quantity <= stock AS accepted
  FROM l WHERE rn = 1
  UNION ALL
  SELECT l.product_id, l.order_item_id, l.rn,
         CASE WHEN l.quantity <= r.rem THEN r.rem - l.quantity ELSE r.rem END,
         l.quantity <= r.rem
  FROM r JOIN l ON l.product_id = r.product_id AND l.rn = r.rn + 1)
SELECT product_id, order_item_id, accepted, CASE WHEN accepted THEN 200 ELSE 400 END AS code FROM r)
UNION ALL
SELECT i.product_id, order_item_id, false, 404
FROM s_order_item i JOIN s_orders o ON i.order_id = o.order_id
WHERE status = 'paid' AND i.product_id NOT IN (SELECT product_id FROM s_products)""",
    "paid_order_outcomes": """
SELECT o.order_id,
       CASE WHEN n IS NULL THEN 404 WHEN refused > 0 THEN 500 ELSE 200 END AS code
FROM s_orders o LEFT JOIN (
  SELECT i.order_id, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(a.accepted, false)) AS refused
  FROM s_order_item i LEFT JOIN (
    WITH RECURSIVE l AS (
      SELECT i.product_id, order_item_id, quantity, stock,
             row_number() OVER (PARTITION BY i.product_id ORDER BY i.order_id, order_item_id) AS rn
      FROM s_order_item i JOIN s_products p ON i.product_id = p.product_id
      JOIN s_orders o ON i.order_id = o.order_id WHERE status = 'paid'),
    r AS (
      SELECT product_id, order_item_id, rn,
             CASE WHEN quantity <= stock THEN stock - quantity ELSE stock END AS rem,
             quantity <= stock AS accepted
      FROM l WHERE rn = 1
      UNION ALL
      SELECT l.product_id, l.order_item_id, l.rn,
             CASE WHEN l.quantity <= r.rem THEN r.rem - l.quantity ELSE r.rem END,
             l.quantity <= r.rem
      FROM r JOIN l ON l.product_id = r.product_id AND l.rn = r.rn + 1)
    SELECT product_id, order_item_id, accepted FROM r
  ) a ON i.product_id = a.product_id AND i.order_item_id = a.order_item_id
  GROUP BY 1
) x ON o.order_id = x.order_id
WHERE o.status = 'paid'""",
    "line_totals": """
SELECT order_item_id, CAST(CAST(quantity * price AS DECIMAL(18,2)) AS DOUBLE) AS total FROM s_order_item""",
    "upsert_products": """
SELECT coalesce(t.product_id, s.product_id) AS product_id,
       CASE WHEN s.product_id IS NULL THEN t.price ELSE s.price END AS price
FROM s_products t FULL JOIN (
  SELECT product_id * 2 AS product_id, CASE WHEN count(*) % 2 = 1 THEN CAST(max(price) AS DOUBLE) END AS price
  FROM s_order_item GROUP BY 1
) s ON t.product_id = s.product_id""",
    "update_with_fallback": """
SELECT t.product_id,
       CAST(CASE WHEN c.stock IS NULL OR c.stock = 0 THEN t.stock ELSE c.stock END AS INTEGER) AS stock
FROM s_products t LEFT JOIN (
  SELECT p.product_id, greatest(p.stock - d.demand, 0) AS stock
  FROM s_products p JOIN (
    SELECT product_id, CAST(sum(quantity) AS BIGINT) AS demand
    FROM s_order_item i JOIN s_orders o ON i.order_id = o.order_id WHERE status = 'paid' GROUP BY 1
  ) d ON p.product_id = d.product_id
) c ON t.product_id = c.product_id""",
    "newsletter_signups": """
SELECT event_id, email,
       CASE WHEN email IN (SELECT email FROM s_newsletter) THEN 409
            WHEN row_number() OVER (PARTITION BY email ORDER BY ts, event_id) = 1 THEN 201
            ELSE 409 END AS code
FROM (SELECT event_id, ts, 'user' || user_id * 20 || '@example.com' AS email FROM events WHERE event_type = 'signup')""",
    "register_users": """
SELECT event_id, CASE WHEN ok THEN 201 ELSE 409 END AS code,
       CASE WHEN ok THEN (SELECT max(user_id) FROM s_users)
                         + row_number() OVER (PARTITION BY ok ORDER BY ts, event_id) END AS user_id
FROM (
  SELECT event_id, ts,
         lower(username) NOT IN (SELECT lower(username) FROM s_users WHERE username IS NOT NULL)
         AND lower(email) NOT IN (SELECT lower(email) FROM s_users WHERE email IS NOT NULL)
         AND row_number() OVER (PARTITION BY lower(username) ORDER BY ts, event_id) = 1 AS ok
  FROM (SELECT event_id, ts, 'Shopper' || user_id AS username, 'New' || event_id || '@Example.com' AS email
        FROM events WHERE event_type = 'signup'))""",
    "insert_orders": """
SELECT event_id, (SELECT coalesce(max(order_id), 0) FROM s_orders)
                 + row_number() OVER (ORDER BY ts, event_id) AS order_id
FROM events WHERE event_type = 'purchase'""",
    "delete_by_ids": """
SELECT order_id FROM s_orders o
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = o.order_id)""",
    "approval_notices": """
SELECT event_id, order_id, 'New Order Placed' AS subject,
       printf('You have a new order, order number %d awaiting your verification', order_id) AS body
FROM s_status_changes WHERE status = 'pending_approval'
  AND order_id IN (SELECT order_id FROM s_orders)""",
    "export_orders": """
SELECT order_id, user_id, total, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
       CAST(NULL AS VARCHAR) AS updated_at, description
FROM s_orders""",
    "order_change_stream": """
SELECT o.order_id, coalesce(c.status, o.status) AS status
FROM s_orders o LEFT JOIN (
  SELECT order_id, arg_max(status, (ts, event_id)) AS status FROM s_status_changes GROUP BY 1
) c ON o.order_id = c.order_id""",
    "order_status_updates": """
SELECT o.order_id, coalesce(c.status, o.status) AS status
FROM s_orders o LEFT JOIN (
  SELECT order_id, arg_max(status, (ts, event_id)) AS status FROM s_status_changes GROUP BY 1
) c ON o.order_id = c.order_id""",
    "category_resolution": """
SELECT p_partkey AS product_id, c.category_id, CASE WHEN c.category_id IS NULL THEN 404 ELSE 200 END AS code
FROM part LEFT JOIN (SELECT category, min(category_id) AS category_id FROM s_categories GROUP BY 1) c
  ON CASE WHEN p_size > 25 THEN p_type ELSE p_brand END = c.category""",
    "users_view_by_ids": """
SELECT user_id, username, email, user_type, is_disabled FROM s_users
WHERE user_id IN (SELECT user_id FROM events)""",
    "restore_orders": """
SELECT order_id, user_id, total,
       CASE WHEN user_id IN (SELECT user_id FROM events) THEN status ELSE 'draft' END AS status,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
       CASE WHEN user_id IN (SELECT user_id FROM events) THEN NULL ELSE '2024-02-01 00:00:00' END AS updated_at,
       description
FROM s_orders
WHERE user_id IN (SELECT user_id FROM events)
   OR order_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""",
    "paid_transitions": """
SELECT order_id, event_id FROM (
SELECT order_id, event_id, ts FROM (
  SELECT c.order_id, c.event_id, c.ts, c.status,
         coalesce(lag(c.status) OVER (PARTITION BY c.order_id ORDER BY c.ts, c.event_id), o.status) AS old
  FROM s_status_changes c JOIN s_orders o ON c.order_id = o.order_id)
WHERE status = 'paid' AND old <> 'paid')""",
    "paid_request_outcomes": """
SELECT t.order_id, t.event_id, CASE WHEN n IS NULL THEN 404 WHEN refused > 0 THEN 500 ELSE 200 END AS code
FROM (
SELECT order_id, event_id, ts FROM (
  SELECT c.order_id, c.event_id, c.ts, c.status,
         coalesce(lag(c.status) OVER (PARTITION BY c.order_id ORDER BY c.ts, c.event_id), o.status) AS old
  FROM s_status_changes c JOIN s_orders o ON c.order_id = o.order_id)
WHERE status = 'paid' AND old <> 'paid') t LEFT JOIN (
  SELECT order_id, event_id, count(*) AS n, count(*) FILTER (WHERE NOT accepted) AS refused
  FROM (
  SELECT * FROM (WITH RECURSIVE l AS (
    SELECT i.product_id, i.order_item_id, i.order_id, t.event_id, i.quantity, p.stock,
           row_number() OVER (PARTITION BY i.product_id ORDER BY t.ts, t.event_id, i.order_id, i.order_item_id, i.quantity) AS rn
    FROM s_order_item i JOIN (
SELECT order_id, event_id, ts FROM (
  SELECT c.order_id, c.event_id, c.ts, c.status,
         coalesce(lag(c.status) OVER (PARTITION BY c.order_id ORDER BY c.ts, c.event_id), o.status) AS old
  FROM s_status_changes c JOIN s_orders o ON c.order_id = o.order_id)
WHERE status = 'paid' AND old <> 'paid') t ON i.order_id = t.order_id JOIN s_products p ON i.product_id = p.product_id),
  r AS (
    SELECT product_id, order_id, event_id, quantity, rn,
           CASE WHEN quantity <= stock THEN stock - quantity ELSE stock END AS rem, quantity <= stock AS accepted
    FROM l WHERE rn = 1
    UNION ALL
    SELECT l.product_id, l.order_id, l.event_id, l.quantity, l.rn,
           CASE WHEN l.quantity <= r.rem THEN r.rem - l.quantity ELSE r.rem END, l.quantity <= r.rem
    FROM r JOIN l ON l.product_id = r.product_id AND l.rn = r.rn + 1)
  SELECT * FROM r)) GROUP BY 1, 2
) a ON t.order_id = a.order_id AND t.event_id = a.event_id""",
    "stock_after_stream": """
SELECT p.product_id, CAST(stock - coalesce(taken, 0) AS BIGINT) AS stock
FROM s_products p LEFT JOIN (
  SELECT product_id, sum(quantity) FILTER (WHERE accepted) AS taken FROM (
  SELECT * FROM (WITH RECURSIVE l AS (
    SELECT i.product_id, i.order_item_id, i.order_id, t.event_id, i.quantity, p.stock,
           row_number() OVER (PARTITION BY i.product_id ORDER BY t.ts, t.event_id, i.order_id, i.order_item_id, i.quantity) AS rn
    FROM s_order_item i JOIN (
SELECT order_id, event_id, ts FROM (
  SELECT c.order_id, c.event_id, c.ts, c.status,
         coalesce(lag(c.status) OVER (PARTITION BY c.order_id ORDER BY c.ts, c.event_id), o.status) AS old
  FROM s_status_changes c JOIN s_orders o ON c.order_id = o.order_id)
WHERE status = 'paid' AND old <> 'paid') t ON i.order_id = t.order_id JOIN s_products p ON i.product_id = p.product_id),
  r AS (
    SELECT product_id, order_id, event_id, quantity, rn,
           CASE WHEN quantity <= stock THEN stock - quantity ELSE stock END AS rem, quantity <= stock AS accepted
    FROM l WHERE rn = 1
    UNION ALL
    SELECT l.product_id, l.order_id, l.event_id, l.quantity, l.rn,
           CASE WHEN l.quantity <= r.rem THEN r.rem - l.quantity ELSE r.rem END, l.quantity <= r.rem
    FROM r JOIN l ON l.product_id = r.product_id AND l.rn = r.rn + 1)
  SELECT * FROM r)) GROUP BY 1
) a ON p.product_id = a.product_id""",
    "order_item_view_orphans": """
SELECT order_item_id, i.order_id,
       CASE WHEN o.order_id IS NULL THEN 'No product found' ELSE CAST(i.product_id AS VARCHAR) END AS product_id,
       name, quantity, i.price, i.total, username
FROM s_order_item i JOIN s_products p ON i.product_id = p.product_id
LEFT JOIN (SELECT * FROM s_orders WHERE order_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')) o
  ON i.order_id = o.order_id
LEFT JOIN s_users u ON o.user_id = u.user_id""",
    "username_lookup": """
SELECT user_id, username FROM s_users
WHERE username IN (SELECT CASE WHEN event_type IN ('signup', 'purchase') THEN 'User' || user_id || '@Example.com'
                               ELSE printf('Customer#%09d', user_id) END FROM events)""",
    "delete_summary": """
SELECT count(*) AS requested,
       count(DISTINCT user_id) FILTER (WHERE user_id IN (SELECT order_id FROM s_orders)) AS deleted,
       CASE WHEN count(*) = 0 THEN 400
            WHEN count(*) FILTER (WHERE user_id IN (SELECT order_id FROM s_orders)) = 0 THEN 404 ELSE 200 END AS code
FROM events WHERE event_type = 'error'""",
    "status_update_rejects": """
SELECT order_id, 404 AS code, 'not found' AS reason FROM s_status_changes
WHERE order_id IN (SELECT user_id FROM events WHERE value > 100) OR order_id NOT IN (SELECT order_id FROM s_orders)""",
    "numbered_orders": """
SELECT event_id, CASE WHEN code = 201 THEN coalesce(given, free) END AS order_id, code FROM (
  SELECT b.event_id, b.given, b.code, f.free FROM (
    SELECT *, row_number() OVER (PARTITION BY given IS NULL ORDER BY ts, event_id) AS k,
           CASE WHEN given IS NULL THEN 201
                WHEN given IN (SELECT order_id FROM s_orders) THEN 409
                WHEN row_number() OVER (PARTITION BY given ORDER BY ts, event_id) > 1 THEN 409 ELSE 201 END AS code
    FROM (SELECT event_id, ts, CASE WHEN value > 50 THEN user_id * 200 END AS given FROM events WHERE event_type = 'purchase')
  ) b LEFT JOIN (
    SELECT free, row_number() OVER (ORDER BY free) AS k FROM (
      SELECT unnest(generate_series((SELECT max(order_id) + 1 FROM s_orders),
                                    (SELECT max(order_id) FROM s_orders) + 2 * (SELECT count(*) FROM events))) AS free
    ) WHERE free NOT IN (SELECT user_id * 200 FROM events WHERE event_type = 'purchase' AND value > 50)
  ) f ON b.given IS NULL AND b.k = f.k)""",
    "insert_users": """
SELECT user_id, username, email, is_disabled FROM s_users
UNION ALL
SELECT (SELECT max(user_id) FROM s_users) + row_number() OVER (ORDER BY ts, event_id),
       lower(username), lower(email), is_disabled
FROM (
  SELECT event_id, ts, 'Shopper' || user_id AS username, 'New' || event_id || '@Example.com' AS email, value > 50 AS is_disabled,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
  FROM events WHERE event_type = 'signup')
WHERE k = 1 AND lower(username) NOT IN (SELECT lower(username) FROM s_users)
  AND lower(email) NOT IN (SELECT lower(email) FROM s_users)""",
    "register_shared_emails": """
SELECT event_id, CASE WHEN reason IS NULL THEN 201 ELSE 409 END AS code, reason FROM (
WITH RECURSIVE l AS (
  SELECT event_id, lower('Shopper' || user_id) AS username, lower('Mail' || CAST(floor(value) AS BIGINT) || '@Example.com') AS email,
         row_number() OVER (ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type = 'signup'),
r AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS reason,
         (SELECT list(lower(username)) FROM s_users) AS names, (SELECT list(lower(email)) FROM s_users) AS mails
  UNION ALL
  SELECT l.rn, l.event_id,
         CASE WHEN list_contains(names, l.username) THEN 'username already exists'
              WHEN list_contains(mails, l.email) THEN 'email already exists' END,
         CASE WHEN list_contains(names, l.username) OR list_contains(mails, l.email) THEN names ELSE list_append(names, l.username) END,
         CASE WHEN list_contains(names, l.username) OR list_contains(mails, l.email) THEN mails ELSE list_append(mails, l.email) END
  FROM r JOIN l ON l.rn = r.rn + 1)
SELECT event_id, reason FROM r WHERE rn > 0)""",
    "update_products": """
SELECT t.product_id,
       CASE WHEN known AND p_size <= 25 THEN upper(p_name) ELSE t.name END AS name,
       CASE WHEN known AND p_size % 5 <> 0 THEN p_size % 5 ELSE t.stock END AS stock,
       CASE WHEN known THEN p_size * 2 + 0.5e0 ELSE t.price END AS price,
       CASE WHEN known THEN p_size > 10 ELSE t.is_disabled END AS is_disabled,
       t.category_id
FROM s_products t JOIN (SELECT *, p_size <= 40 AS known FROM part) p ON t.product_id = p_partkey""",
    "orphan_report": _AFTER_DELETES + """
SELECT child, "column", parent, CAST(key AS VARCHAR) AS missing_key, count(*) AS n
FROM refs WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.parent = refs.parent AND p.key = refs.key)
GROUP BY ALL""",
    "orphan_summary": _AFTER_DELETES + """
SELECT child, "column", parent, count(key) AS referring, count(*) - count(key) AS null_refs, count(DISTINCT key) AS keys,
       count(DISTINCT key) FILTER (WHERE lost) AS missing_keys, count(*) FILTER (WHERE lost) AS orphans
FROM (SELECT *, key IS NOT NULL AND (parent, key) NOT IN (SELECT (parent, key) FROM parents) AS lost FROM refs)
GROUP BY ALL""",
    "orphan_lines": _AFTER_DELETES + """
SELECT order_item_id, quantity,
       concat_ws(',', CASE WHEN product_id NOT IN (SELECT product_id FROM d_products) THEN 'product_id' END,
                 CASE WHEN order_id NOT IN (SELECT order_id FROM d_orders) THEN 'order_id' END) AS missing
FROM s_order_item
WHERE product_id NOT IN (SELECT product_id FROM d_products) OR order_id NOT IN (SELECT order_id FROM d_orders)""",
    "stock_check_text_ids": """
SELECT event_id, r.order_id, r.product_id,
       CASE WHEN o.order_id IS NULL OR l.order_item_id IS NULL OR p.product_id IS NULL THEN 404
            WHEN l.quantity > stock THEN 422 ELSE 200 END AS code,
       CASE WHEN o.order_id IS NULL THEN 'order not found' WHEN l.order_item_id IS NULL THEN 'unable to fetch order item stock quantity'
            WHEN p.product_id IS NULL THEN 'unable to fetch product quantity' WHEN l.quantity > stock THEN 'Insufficient stock.' END AS error
FROM (
  SELECT event_id, user_id || '-1' AS order_item_id,
         CASE event_type WHEN 'click' THEN user_id WHEN 'error' THEN NULL WHEN 'signup' THEN user_id ELSE user_id + 8589934592 END AS order_id,
         CASE WHEN value > 90 THEN NULL ELSE user_id END AS product_id
  FROM events) r
LEFT JOIN s_orders o ON r.order_id = o.order_id
LEFT JOIN (SELECT order_item_id, arg_min(quantity, (order_id, quantity)) AS quantity FROM s_order_item GROUP BY 1) l
  ON r.order_item_id = l.order_item_id
LEFT JOIN s_products p ON r.product_id = p.product_id""",
    "export_all": _CONTENT,
    "restore_all": _CONTENT,
}


def oracle_sql() -> dict[str, str]:
    return {name: SHOP_CTE + body for name, body in _BODIES.items()}
