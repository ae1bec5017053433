"""The three analyses as whole plans, and the queries bound to the test tables."""
