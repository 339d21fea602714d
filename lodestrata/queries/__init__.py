"""The registered queries: named DataFrame builders with their SQL twins."""
