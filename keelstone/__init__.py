"""keelstone: grounded-rule analytics on Spark."""
