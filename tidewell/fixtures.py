"""Catalogs and statistics that stand in for a live server's, as plain data."""

from __future__ import annotations

from tidewell.sources.catalog import CatalogSpec, ColumnSpec, ForeignKey, TableSpec


def _columns(text: str) -> tuple[ColumnSpec, ...]:
    """Columns from lines "name type [!] [pk] [pii] [-- comment]"."""
    out = []
    for line in text.strip().splitlines():
        spec, _, comment = line.strip().partition(" -- ")
        name, kind, *flags = spec.split()
        out.append(ColumnSpec(name, kind, "!" in flags or "pk" in flags, comment or None, "pk" in flags, "pii" in flags))
    return tuple(out)


#: The tables that the driver makes, with their keys.
WAREHOUSE = CatalogSpec(
    (
        TableSpec("public.region", _columns("r_regionkey int pk\nr_name string ! -- Region name"), comment="World regions (aka areas)", row_estimate=5),
        TableSpec("public.nation", _columns("n_nationkey int pk\nn_name string ! -- Nation name (country)\nn_regionkey int !"), comment="Nations", row_estimate=25, foreign_keys=(ForeignKey(("n_regionkey",), "public.region", ("r_regionkey",)),), indexes=(("n_nationkey",),)),
        TableSpec("public.customer", _columns("c_custkey bigint pk\nc_name string ! pii -- Customer name\nc_nationkey int !\nc_acctbal double -- Account balance (amt)\nc_mktsegment string -- Market segment"), comment="Customers who place orders (aka clients)", row_estimate=1500, foreign_keys=(ForeignKey(("c_nationkey",), "public.nation", ("n_nationkey",)),), indexes=(("c_custkey",), ("c_nationkey",))),
        TableSpec("public.supplier", _columns("s_suppkey bigint pk\ns_name string !\ns_nationkey int !\ns_acctbal double"), comment="Suppliers of parts (vendors)", row_estimate=100, foreign_keys=(ForeignKey(("s_nationkey",), "public.nation", ("n_nationkey",)),), indexes=(("s_suppkey",),)),
        TableSpec("public.part", _columns("p_partkey bigint pk\np_name string ! -- Product name\np_brand string\np_type string\np_size int\np_retailprice double -- List price"), comment="Parts (products)", row_estimate=2000, indexes=(("p_partkey",),)),
        TableSpec("public.orders", _columns("o_orderkey bigint pk\no_custkey bigint !\no_orderstatus string\no_totalprice double -- Total price\no_orderdate timestamp -- Order date\no_orderpriority string"), comment="Purchase orders (aka purchases)", row_estimate=15000, foreign_keys=(ForeignKey(("o_custkey",), "public.customer", ("c_custkey",)),), indexes=(("o_orderkey",), ("o_custkey", "o_orderdate"))),
        TableSpec("public.lineitem", _columns("l_orderkey bigint !\nl_partkey bigint !\nl_suppkey bigint !\nl_linenumber int !\nl_quantity double -- qty\nl_extendedprice double\nl_discount double\nl_tax double\nl_returnflag string\nl_linestatus string\nl_shipdate timestamp -- Ship dt"), comment="Lines of orders", row_estimate=60000, foreign_keys=(ForeignKey(("l_orderkey",), "public.orders", ("o_orderkey",)), ForeignKey(("l_partkey",), "public.part", ("p_partkey",)), ForeignKey(("l_suppkey",), "public.supplier", ("s_suppkey",))), indexes=(("l_orderkey", "l_linenumber"),)),
        TableSpec("public.events", _columns("event_id bigint pk\nts timestamp !\nuser_id bigint\nevent_type string\nvalue double\nprops string -- JSON properties"), comment="Events of users (log)", row_estimate=10000),
        TableSpec("public.documents", _columns("doc_id bigint pk\ntext string\nlang string -- Language\nsource string\nn_chars bigint"), comment="Texts", row_estimate=1000),
        TableSpec("public.labels", _columns("doc_id bigint pk\nquality int\ntoxic int"), comment="Labels of documents", row_estimate=400, foreign_keys=(ForeignKey(("doc_id",), "public.documents", ("doc_id",)),)),
        TableSpec("public.customer_backup", _columns("c_custkey bigint\nc_name string"), comment="Copy of customer", row_estimate=10),
        TableSpec("public.customer_hidden", _columns("c_custkey bigint\nc_name string"), comment="Customers held back", row_estimate=10, excluded=True),
        TableSpec("sales.customer_view", _columns("c_custkey bigint\nc_name string"), kind="view", comment="Customers of sales", definition="SELECT c_custkey, c_name FROM customer"),
    )
)

#: A shop whose keys are told by names only.
SHOP = CatalogSpec(
    (
        TableSpec("shop.users", _columns("id bigint pk\nemail string\nname string"), row_estimate=100),
        TableSpec("shop.orders", _columns("id bigint pk\nuser_id bigint\naddress_id bigint\ntotal double"), row_estimate=500, indexes=(("id",),)),
        TableSpec("shop.addresses", _columns("address_id bigint pk\ncity string"), row_estimate=80),
        TableSpec("shop.categories", _columns("id bigint pk\ntitle string"), row_estimate=8),
        TableSpec("shop.products", _columns("sku string\nid bigint\ncategory_id bigint\nsupplier_id bigint"), row_estimate=50),
        TableSpec("shop.order_items", _columns("order_id bigint\nproduct_id bigint\nquantity int"), row_estimate=900, foreign_keys=(ForeignKey(("order_id",), "shop.orders", ("id",)),)),
        TableSpec("other.product", _columns("id bigint pk"), row_estimate=5),
    )
)

TABLE_STATS = [
    ("public.orders", 900, 100, 15000, 3000),
    ("public.lineitem", 5000, 20, 60000, 0),
    ("public.customer", 100, 4000, 1500, 1200),
    ("public.events", 101, 0, 10000, 10000),
    ("public.region", 7, 0, 5, 0),
    ("public.archive", 0, 0, 0, 1001),
]
TABLE_STATS_SCHEMA = "ref string, seq_scan long, idx_scan long, n_live long, n_dead long"

INDEX_STATS = [
    ("public.orders", "orders_pkey", 5000, 400000, True, True),
    ("public.orders", "orders_date_idx", 0, 120000, False, False),
    ("public.orders", "orders_status_idx", 12, 90000, False, False),
    ("public.customer", "customer_email_key", 0, 50000, True, False),
    ("public.customer", "customer_fk_idx", 0, 60000, False, False),
    ("public.events", "events_props_idx", 0, 900000, False, False),
]
INDEX_STATS_SCHEMA = "ref string, index string, idx_scan long, size_bytes long, is_unique boolean, is_primary boolean"
CONSTRAINED_INDEXES = [("customer_fk_idx",)]

LOCKS = [
    (11, "relation", 1, 500, None, None, None, None, None, None, "AccessExclusiveLock", False),
    (12, "relation", 1, 500, None, None, None, None, None, None, "RowExclusiveLock", True),
    (13, "relation", 1, 501, None, None, None, None, None, None, "RowExclusiveLock", True),
    (14, "tuple", 1, 500, 3, 7, None, None, None, None, "ExclusiveLock", False),
    (15, "tuple", 1, 500, 3, 7, None, None, None, None, "ShareLock", True),
    (16, "transactionid", None, None, None, None, None, 77, None, None, "ShareLock", False),
    (17, "transactionid", None, None, None, None, None, 77, None, None, "ExclusiveLock", True),
    (12, "transactionid", None, None, None, None, None, 78, None, None, "ExclusiveLock", True),
]
LOCKS_SCHEMA = "pid int, locktype string, database int, relation int, page int, tuple int, virtualxid string, transactionid int, classid int, objid int, mode string, granted boolean"
