"""Coupon-redemption feature building, training and scoring on Spark DataFrames."""
