"""Relational operators over reports, leads, receipts, captures, labels and reviews."""
