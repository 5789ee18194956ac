"""ledgerframe: bank-ledger reconciliation and serving as Spark DataFrame operators."""
