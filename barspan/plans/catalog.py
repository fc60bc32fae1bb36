"""All queries over the market tables, with their SQL where SQL expresses them."""

from barspan.plans import bars_plans, output_plans, portfolio_plans, source_plans

QUERIES = source_plans.QUERIES | bars_plans.QUERIES | portfolio_plans.QUERIES | output_plans.QUERIES
SQL = source_plans.SQL | bars_plans.SQL | portfolio_plans.SQL | output_plans.SQL
