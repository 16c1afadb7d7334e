"""Imputation, outliers, anomalies, cleaning reports and the action fold."""
