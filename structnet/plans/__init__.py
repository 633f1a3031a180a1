"""Run options and the end-to-end job."""
